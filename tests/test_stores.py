"""Stores by key: only what is asked for is opened; the log-structured table against a dictionary."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tileflow.functions import address as A
from tileflow.sources import files, metatile, segments, stores

KEY = ["style", "z", "mx", "my"]


def _blobs(spark, n=40):
    rows = [("s", 10, 8 * i, 16, 8 * i + k, 16 + k, f"tile {i} {k}".encode()) for i in range(n) for k in range(2)]
    tiles = spark.createDataFrame(rows, "style string, z int, mx long, my long, x long, y long, data binary")
    return tiles, metatile.encoded(tiles, KEY).withColumn("mtime", F.expr("TIMESTAMP_NTZ '2024-01-05 10:00:00'"))


def test_only_files_asked_for_are_opened(spark, tmp_path):
    """All other files are made folders, which can't be opened as files."""
    tiles, blobs = _blobs(spark)
    store = stores.FileStore(str(tmp_path), now="2024-01-06 00:00:00")
    store.write(blobs)
    paths = {r.mx: r.path for r in blobs.select("mx", store.path(blobs).alias("path")).collect()}
    for mx, path in paths.items():
        if mx != 80:
            os.remove(path)
            os.mkdir(path)
    got = store.read(tiles.where("mx = 80").select("style", "z", "x", "y").union(tiles.where("mx = 80").select("style", "z", "x", "y"))).collect()
    assert sorted((r.x, r.status, r.data) for r in got) == [(80, 9, b"tile 10 0")] * 2 + [(81, 9, b"tile 10 1")] * 2
    with pytest.raises(Exception, match="IsADirectoryError"):
        store.read(tiles.where("mx = 88").select("style", "z", "x", "y")).collect()


def test_file_stat_knows_imports(spark, tmp_path):
    _, blobs = _blobs(spark, 2)
    at = lambda day: dt.datetime(2024, 1, day, tzinfo=dt.UTC).timestamp()
    asked = spark.createDataFrame([("s", 10, 0, 16), ("s", 10, 800, 800)], "style string, z int, x long, y long")
    store = stores.FileStore(str(tmp_path), now="2024-01-07 00:00:00")
    store.write(blobs)
    stat = lambda: {r.x: (r.size > 0, r.expired) for r in store.stat(asked).collect()}
    assert stat() == {0: (True, False), 800: (False, True)}
    files.mark_import(store.root, None, at(6))
    assert stat()[0] == (True, True)
    files.mark_import(store.root, "s", at(4))
    assert stat()[0] == (True, False)
    assert stores.FileStore(str(tmp_path), now="2024-01-20 00:00:00").stat(asked).where("x = 0").first().expired is False


def test_listing_and_bad_containers(spark, tmp_path):
    _, blobs = _blobs(spark)
    store = stores.FileStore(str(tmp_path))
    store.write(blobs)
    got = stores.scan(spark, store.root, ["s", "none"], 9, 11).collect()
    assert sorted(r.path for r in got) == sorted(r.path for r in blobs.select(store.path(blobs).alias("path")).collect())
    assert {(r.mtime, r.size > 532) for r in got} == {(dt.datetime(2024, 1, 5, 10), True)}
    path = got[0].path
    whole = open(path, "rb").read()
    asked = spark.createDataFrame([(path, [0, 9]), (path + "x", [1])], "path string, slots array<int>")
    for blob, codes in ((b"", [-2, -2]), (whole[:12], [-3, -3]), (b"MOTE" + whole[4:], [-4, -4]), (whole[:4] + b"\x3f" + whole[5:], [-5, -5]), (whole[:100], [-3, -3]), (whole[:-1], [8, -8]), (whole, [8, 8])):
        open(path, "wb").write(blob)
        want = [metatile.unpack(blob, slot // 8, slot % 8)[0] for slot in (0, 9)]
        found = {(r.path == path, r.slot): r.status for r in files.tiles(asked).collect()}
        assert [found[True, s] for s in (0, 9)] == want
        assert [min(w, 0) for w in want] == [min(c, 0) for c in codes]
        assert found[False, 1] == -1


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_a_dictionary(spark, tmp_path, seed):
    """Random writes, expiries, deletions and merges; two rows of a key in one write; reads by key."""
    r, want, n = random.Random(seed), {}, 12
    store = stores.TableStore("rados", str(tmp_path / "t"))
    day = lambda d: dt.datetime(2024, 1, d)
    for step in range(12):
        keys = r.sample(range(n), r.randint(1, 5))
        op = r.choice(["write", "write", "write", "expire", "delete", "merge", "compact"]) if step else "write"
        rows = spark.createDataFrame([("s", 10, 8 * k, 0) for k in keys], "style string, z int, mx long, my long")
        if op == "write":
            blob = {k: f"{step} {k}".encode() for k in keys}
            twice = [("s", 10, 8 * k, 0, day(step + 1), b) for k, b in blob.items()] + [("s", 10, 8 * k, 0, day(step + 1), b" ") for k in keys]
            store.write(spark.createDataFrame(twice, "style string, z int, mx long, my long, mtime timestamp_ntz, blob binary"))
            want |= {k: (day(step + 1), False, b) for k, b in blob.items()}
        elif op == "expire":
            store.expire(rows.union(rows))
            want |= {k: (want[k][0], True, want[k][2]) for k in keys if k in want}
        elif op == "delete":
            store.delete(rows.union(rows))
            want = {k: x for k, x in want.items() if k not in keys}
        elif op == "merge":
            store.runs.merge(spark)
        else:
            store.runs.compact(spark)
            store.runs.vacuum(spark)
    for last in ("as it is", "merged", "compacted"):
        if last == "merged":
            segments.Segments(store.table, fan=2).merge(spark)
            segments.Segments(store.table).vacuum(spark)
        if last == "compacted":
            store.runs.compact(spark)
            store.runs.vacuum(spark)
            assert len(store.runs.runs()) == 1
        known = store.runs.latest(spark, "mx", "mtime", "expired", "blob_run")
        blobs = {x.key: bytes(x.blob) for x in store.runs.blobs(known.select("key", "blob_run")).collect()}
        assert {x.mx // 8: (x.mtime, x.expired, blobs[x.key]) for x in known.collect()} == want


def test_writers_do_not_lose_each_other(spark, tmp_path):
    """A commit that comes second is made again on top of the first; a merge of runs that are gone is dropped."""
    a, b = segments.Segments(str(tmp_path)), segments.Segments(str(tmp_path))
    first = a._manifest
    calls = []

    def late():
        found = first()
        if not calls:
            calls.append(1)
            b._commit(lambda runs: [*runs, {"name": "b", "level": 0}])
        return found

    a._manifest = late
    a._commit(lambda runs: [*runs, {"name": "a", "level": 0}])
    assert [r["name"] for r in b.runs()] == ["b", "a"]
    b._commit(lambda runs: None)
    assert [r["name"] for r in a.runs()] == ["b", "a"]


def test_reads_shuffle_keys_only(spark, tmp_path):
    _, blobs = _blobs(spark)
    store = stores.TableStore("memcached", str(tmp_path / "t"))
    store.write(blobs)
    asked = spark.createDataFrame([("s", 10, 80, 16)], "style string, z int, x long, y long")
    known = store._known(asked, "blob_run")
    plan = store.runs.blobs(known)._jdf.queryExecution().executedPlan().toString()
    assert "blob_run:string" in plan
    assert "blob:binary" not in plan  # no scan of Spark's reads contents
    key = A.store_keys(F.lit("s"), F.lit(10), F.lit(80), F.lit(16), F.lit(""))["memcached_key"]
    assert [bytes(r.blob) for r in store.runs.blobs(known).collect()] == [bytes(r.blob) for r in blobs.where("mx = 80").collect()]
    assert spark.range(1).select(key.alias("k")).first().k == known.first().key


def test_writes_look_at_their_rows_once(spark, tmp_path):
    """A write to a key-value store took its metatiles twice, for blobs and for the index."""
    _, blobs = _blobs(spark)
    n, seen = blobs.count(), spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store = stores.TableStore("memcached", str(tmp_path / "t"))
    store.write(blobs.mapInArrow(run, blobs.schema))
    assert seen.value == n


def test_tiles_leave_the_tasks_that_read_blobs(spark, tmp_path):
    tiles, blobs = _blobs(spark)
    store = stores.TableStore("rados", str(tmp_path / "t"))
    store.write(blobs)
    asked = tiles.select("style", "z", "x", "y", F.col("data").alias("want")).unionAll(spark.createDataFrame([("none", 10, 80, 16, None)], "style string, z int, x long, y long, want binary"))
    got = store.read(asked.unionAll(asked)).collect()
    assert len(got) == 2 * asked.count()
    assert all((r.status, r.data, r.compressed) == ((-1, None, None) if r.style == "none" else (len(r.want or b""), r.want or b"", False)) for r in got)
    plan = store.runs.tiles(store._known(asked, "blob_run").withColumn("slots", F.array(F.lit(0))))
    assert plan.columns == ["key", "slot", "status", "data", "compressed"]


def test_listing_is_dealt_by_folders_of_any_zoom(spark, tmp_path):
    """Below zoom 17 all files of a style and zoom lie in one first-level folder, so one task listed them."""
    rows = [("s", 16, 4096 * i, 4096 * k, 4096 * i, 4096 * k, b"tile") for i in range(8) for k in range(8)]
    blobs = metatile.encoded(spark.createDataFrame(rows, "style string, z int, mx long, my long, x long, y long, data binary"), KEY)
    store = stores.FileStore(str(tmp_path))
    store.write(blobs)
    reader = stores.MetaReader({"root": str(tmp_path)})
    shares = [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()]
    assert sum(shares) == 64
    assert max(shares) < 10
    back = spark.read.format("metatiles").option("root", str(tmp_path)).load()
    assert {(r.path, bytes(r.blob)) for r in back.collect()} == {(r.path, bytes(r.blob)) for r in blobs.select(store.path(blobs).alias("path"), "blob").collect()}
    assert not [n for _, _, names in os.walk(tmp_path) for n in names if not n.endswith(".meta")]
