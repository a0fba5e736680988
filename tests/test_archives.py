"""Packed file stores: the files of a tree in a few archives, with the same results for all operations."""

import datetime as dt
import multiprocessing
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tileflow.functions import address as A
from tileflow.sources import archives, files, metatile, shared, stores
from tileflow.sources.views import Views

KEY = ["style", "z", "mx", "my"]


def _blobs(spark, n=40, z=20):
    rows = [("s", z, 4096 * i, 16, 4096 * i + k, 16 + k, f"tile {i} {k}".encode()) for i in range(n) for k in range(2)]
    tiles = spark.createDataFrame(rows, "style string, z int, mx long, my long, x long, y long, data binary")
    return tiles, metatile.encoded(tiles, KEY).withColumn("mtime", F.expr("TIMESTAMP_NTZ '2024-01-05 10:00:01'"))


def _inodes(folder):
    return sum(len(d) + len(f) for _, d, f in os.walk(folder))


def _events(spark, folder, n):
    """Requests of one style and zoom 20, hardly two of a metatile."""
    rows = spark.range(n).select((F.col("id") * 21 + 20).alias("event_id"), F.expr("TIMESTAMP_NTZ '2024-01-05 10:00:00'").alias("ts"), (F.col("id") % 977).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _taken(spark, tmp_path, name, n=2000):
    """Inodes that a query leaves in its store, and its rows."""
    own = shared.own_folder(spark)
    before = set(os.listdir(own)) if os.path.isdir(own) else set()
    rows = __spark_entry__.queries()[name](spark, _events(spark, tmp_path, n)).collect()
    return sum(_inodes(f"{own}/{d}") for d in set(os.listdir(own)) - before if d.startswith("store-")), rows


def test_file_tile_read_takes_few_inodes(spark, tmp_path):
    """A tree took about three inodes, of 4 KB each, for a metatile: 34 million for 36 million requests."""
    taken, rows = _taken(spark, tmp_path, "file_tile_read")
    assert len(rows) == 2000
    assert all(r.status == len(r.data) for r in rows)
    assert taken <= 2 * archives.SHELVES + 2


@pytest.mark.parametrize("packed", [False, True])
def test_reads_and_bad_containers(spark, tmp_path, packed):
    """What a tree answers, a packed store does too: tiles, missing files, containers spoiled or empty."""
    tiles, blobs = _blobs(spark)
    store = stores.FileStore(str(tmp_path), packed=packed)
    whole = bytes(blobs.where("mx = 0").first().blob)
    bad = [b"", whole[:12], b"MOTE" + whole[4:], whole[:4] + b"\x3f" + whole[5:], whole[:100], whole[:-1], b"METZ" + whole[4:]]
    spoiled = spark.createDataFrame([("s", 20, 4096 * i, 16, b) for i, b in enumerate(bad)], "style string, z int, mx long, my long, blob binary")
    store.write(blobs)
    store.write(spoiled)
    asked = tiles.select("style", "z", "x", "y").unionAll(spark.createDataFrame([("s", 20, 8, 8), ("none", 20, 0, 0)], "style string, z int, x long, y long"))
    got = {(r.style, r.x): (r.status, r.data, r.compressed) for r in store.read(asked.unionAll(asked)).collect()}
    for i in range(40):
        for k in range(2):
            want = metatile.unpack(bad[i], k, k) if i < len(bad) else (len(f"tile {i} {k}"), f"tile {i} {k}".encode(), False)
            assert got["s", 4096 * i + k][:2] == want[:2]
            assert want[0] < 0 or got["s", 4096 * i + k][2] == want[2]
    assert got["s", 8] == got["none", 0] == (-1, None, None)
    assert len(got) == 82


def test_changes_equal_those_of_a_tree(spark, tmp_path):
    """Writes over what is there, deletions, expiries and times out of a zip file's own range."""
    times = ["2024-02-29 10:00:00", "1970-01-01 00:00:00", "1950-06-01 00:00:00", "2200-01-01 00:00:00", "2005-12-31 23:59:59", "2024-01-05 10:00:01"]
    _, blobs = _blobs(spark)
    rows = blobs.withColumn("mtime", F.element_at(F.array(*[F.expr(f"TIMESTAMP_NTZ '{t}'") for t in times]), (F.col("mx") / 4096 % len(times) + 1).cast("int")))
    states = []
    for packed in (False, True):
        root = str(tmp_path / f"{packed}")
        store = stores.open_store(root, packed=packed) or stores.FileStore(root, packed=packed)
        listed = lambda store=store, root=root, packed=packed: sorted((r.path.removeprefix(root), r.mtime, r.size) for r in stores.scan(spark, root, ["s"], 0, 20, packed).collect())
        seen = []
        store.delete(rows)  # nothing is there yet
        store.write(rows.where("mx < 100000"))
        store.write(rows)
        seen.append(listed())
        store.delete(rows.where("mx < 20000"))
        store.expire(rows.where("mx < 120000").unionByName(rows.where("mx >= 40000 AND mx < 60000")))
        seen.append(listed())
        store.write(rows.where("mx = 0").withColumn("mtime", F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'")))
        seen.append(listed())
        store.delete(rows)
        seen.append(listed())
        states.append(seen)
    assert states[0] == states[1]
    assert [len(s) for s in states[1]] == [40, 35, 36, 0]
    assert not [n for _, _, names in os.walk(tmp_path / "True") for n in names if not n.endswith(".lock")]


def test_archives_unpack_into_the_tree(spark, tmp_path):
    tiles, blobs = _blobs(spark)
    store = stores.FileStore(str(tmp_path / "packed"), packed=True)
    store.write(blobs)
    for folder, _, names in os.walk(store.root):
        for n in names:
            if n.endswith(".zip"):
                with zipfile.ZipFile(f"{folder}/{n}") as f:
                    assert f.testzip() is None
                    f.extractall(str(tmp_path / "tree" / os.path.relpath(folder, store.root)))
    got = stores.FileStore(str(tmp_path / "tree")).read(tiles.select("style", "z", "x", "y", F.col("data").alias("want"))).collect()
    assert [r.data for r in got] == [r.want for r in got]
    assert len(got) == 80


def _add(path, i):
    for k in range(5):
        archives.change(path, iter([(f"0/0/0/{i}/{k}.meta", 1_000_000, b"x" * i)]), "write")


def test_writers_of_an_archive_do_not_lose_each_other(tmp_path):
    path = str(tmp_path / "s" / "20" / "00.zip")
    running = [multiprocessing.get_context("spawn").Process(target=_add, args=(path, i)) for i in range(4)]
    for p in running:
        p.start()
    for p in running:
        p.join()
    with archives.Archive(path) as found:
        assert sorted((n, i.file_size) for n, i in found.members.items()) == [(f"0/0/0/{i}/{k}.meta", i) for i in range(4) for k in range(5)]


def test_archive_of_a_path(spark):
    """Spark and the tasks place a path alike; a store's own path makes no difference."""
    paths = spark.range(300).select(A.hashed_path(F.lit("/a b/c"), F.lit("s"), F.lit(20), F.col("id") * 8, F.col("id") * 4096).alias("path"))
    rows = paths.select("path", archives.archive(F.col("path")).alias("archive")).collect()
    assert all(archives.place(r.path)[0] == r.archive for r in rows)
    assert len({r.archive for r in rows}) > 32
    assert {archives.place(r.path.removeprefix("/a b"))[0] for r in rows} == {r.archive.removeprefix("/a b") for r in rows}


def test_file_tile_stat_takes_few_inodes(spark, tmp_path):
    taken, rows = _taken(spark, tmp_path, "file_tile_stat")
    assert len(rows) == 2000
    assert 400 < sum(r.size < 0 for r in rows) <= 500
    assert all(r.expired == (r.size < 0 or r.mtime < dt.datetime(2024, 1, 10)) for r in rows)
    assert taken <= 2 * archives.SHELVES + 5


def test_packed_stat_knows_imports(spark, tmp_path):
    _, blobs = _blobs(spark, 2)
    asked = spark.createDataFrame([("s", 20, 0, 16), ("s", 20, 800, 800), ("none", 20, 0, 0)], "style string, z int, x long, y long")
    store = stores.FileStore(str(tmp_path), now="2024-01-07 00:00:00", packed=True)
    store.write(blobs)
    size = blobs.where("mx = 0").select(F.length("blob")).first()[0]
    stat = lambda: {(r.style, r.x): (r.size, r.mtime, r.expired) for r in store.stat(asked.unionAll(asked)).collect()}
    assert stat() == {("s", 0): (size, dt.datetime(2024, 1, 5, 10, 0, 1), False), ("s", 800): (-1, None, True), ("none", 0): (-1, None, True)}
    files.mark_import(store.root, None, dt.datetime(2024, 1, 6, tzinfo=dt.UTC).timestamp())
    assert stat()["s", 0][2]
    files.mark_import(store.root, "s", dt.datetime(2024, 1, 4, tzinfo=dt.UTC).timestamp())
    assert not stat()["s", 0][2]


def test_metatile_write_takes_few_inodes(spark, tmp_path):
    taken, rows = _taken(spark, tmp_path, "metatile_write")
    want = Views(spark, str(tmp_path)).tile_requests.select(*KEY).distinct().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))
    assert taken <= 2 * archives.SHELVES + 2


def test_source_reads_archives(spark, tmp_path):
    _, blobs = _blobs(spark)
    store = stores.FileStore(str(tmp_path), packed=True)
    store.write(blobs)
    back = spark.read.format("metatiles").option("root", str(tmp_path)).option("packed", True).load()
    want = {(r.path, dt.datetime(2024, 1, 5, 10, 0, 1), len(r.blob), bytes(r.blob)) for r in blobs.select(store.path(blobs).alias("path"), "blob").collect()}
    assert {(r.path, r.mtime, r.size, bytes(r.blob)) for r in back.collect()} == want
    assert {r.blob for r in back.sparkSession.read.format("metatiles").option("root", str(tmp_path)).option("packed", True).option("contents", False).load().collect()} == {None}


def test_paths_are_matched_once(spark):
    """Each number of a path was matched anew wherever it was used: more than a hundred times a path."""
    paths = spark.createDataFrame([("/t/s/10/0/0/0/1/128.meta",), ("/t/s/10/0/0/0/1/300.meta",), ("/t/s/3/0/0/0/1/128.meta",), ("x",), (None,)], "path string")
    out = stores.parsed(paths, "/t")
    assert out.collect() == [("/t/s/10/0/0/0/1/128.meta", "s", 10, 8, 16)]
    assert paths.select(A.parse_path("/t", F.col("path"))["code"]).collect() == [(0,), (2,), (3,), (1,), (1,)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_replace") + plan.count("regexp_extract") == 1


def test_scan_meta_takes_few_inodes(spark, tmp_path):
    taken, rows = _taken(spark, tmp_path, "scan_meta")
    assert rows == []  # all requests are of zoom 20
    assert taken <= 2 * archives.SHELVES + 2


def test_scan_opens_archives_of_its_folders_only(spark, tmp_path):
    """All other archives are spoiled."""
    _, blobs = _blobs(spark, z=18)
    store = stores.FileStore(str(tmp_path), packed=True)
    for style in ("s", "t"):
        store.write(blobs.withColumn("style", F.lit(style)).unionByName(blobs.withColumn("style", F.lit(style)).withColumn("z", F.lit(19))))
    for folder in ("s/19", "t/18", "t/19"):
        for n in os.listdir(tmp_path / folder):
            (tmp_path / folder / n).write_bytes(b"no archive")
    got = stores.scan(spark, store.root, ["s", "none"], 17, 18, packed=True).collect()
    assert sorted(r.path for r in got) == sorted(r.path for r in blobs.select(store.path(blobs).alias("path")).collect())
    with pytest.raises(Exception, match="BadZipFile"):
        stores.scan(spark, store.root, ["s"], 18, 19, packed=True).collect()
