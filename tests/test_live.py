"""Streams with state: they equal plain programs however their input is cut into batches, and forget what they can."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import run
from tileflow.functions.web import ServerConfig
from tileflow.operators import connections
from tileflow.operators import freshness as fr
from tileflow.operators.throttle import Bucket
from tileflow.streaming import live

KEY = ["style", "z", "mx", "my"]


def batches(spark, rows, schema, tmp_path, sizes, name="in"):
    """A stream that gives the rows in batches of these sizes."""
    at = 0
    for i, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
        at += n
    assert at == len(rows)
    top = tmp_path / name
    top.mkdir()
    for i in range(len(sizes)):
        for f in (tmp_path / f"{name}-{i}").glob("part-*.parquet"):
            shutil.move(f, top / f"{i:03d}.parquet")
            os.utime(top / f"{i:03d}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(top))


def cuts(n, parts, seed):
    r = random.Random(seed)
    edges = sorted(r.sample(range(1, n), parts - 1))
    return [b - a for a, b in zip([0, *edges], [*edges, n], strict=True)]


def state_rows(df, tmp_path, name="state"):
    """Rows of state left at the end of a run."""
    q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress[-1].stateOperators[0].numRowsTotal, df.sparkSession.read.parquet(str(tmp_path / f"{name}-out"))


def test_buckets_are_forgotten(spark, tmp_path):
    """Many clients that ask once and come again much later: as the plain buckets say, and state does not grow with clients."""
    rng = random.Random(3)
    cfg = ServerConfig(delaypool_tile_size=2, delaypool_render_size=1, delaypool_tile_rate=1_000_000, delaypool_render_rate=2_000_000)
    rows = sorted((rng.randrange(2_000_000_000), f"10.0.{rng.randrange(150)}") for _ in range(600))
    rows += [(t, "10.1") for t in range(2_000_000_000, 2_003_000_000, 100_000)]
    rows = [(i, c, us, rng.random() < 0.3) for i, (us, c) in enumerate(rows)]
    df = batches(spark, rows, "req_id long, client_ip string, us long, missing boolean", tmp_path, cuts(len(rows), 6, 1))
    left, out = state_rows(live.throttled(df, cfg, late="0 seconds"), tmp_path)
    buckets = {}
    want = {i: buckets.setdefault(c, Bucket(cfg)).allow(us, m) for i, c, us, m in rows}
    assert {r.req_id: r.allowed for r in out.collect()} == want
    assert 0 < sum(want.values()) < len(want)
    assert left < 60 < len(buckets)


def frames_of(rng, n):
    out = []
    for i in range(n):
        ver = rng.choice([1, 2, 3])
        out.append(ver.to_bytes(4, "little") + i.to_bytes(4, "little") + rng.randbytes(connections.SIZES[ver] - 8))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_cut_anywhere(spark, tmp_path, seed):
    """Batch and stream; chunks that overtake others, a bad frame, a last frame that never ends, repeated chunks."""
    rng, want, rows = random.Random(seed), {}, []
    for conn in range(6):
        frames = frames_of(rng, 12)
        whole = b"".join(frames)
        want[conn] = frames
        if conn == 1:
            whole = b"".join(frames[:4]) + (7).to_bytes(4, "little") + whole
            want[conn] = frames[:4]
        if conn == 2:
            whole, want[conn] = whole + b"\x01\0\0\0\0", frames
        if conn == 3:
            whole, want[conn] = b"\x02\0", []
        edges = sorted(rng.sample(range(len(whole) + 1), min(len(whole), 30)))
        parts = [whole[a:b] for a, b in zip([0, *edges], [*edges, len(whole)], strict=True)]
        rows += [(conn, i, p) for i, p in enumerate(parts)]
    schema = "conn long, seq long, chunk binary"
    got = {c: [] for c in want}
    for r in sorted(connections.reassembled(spark.createDataFrame(rows, schema).repartition(3)).collect()):
        assert r.n == len(got[r.conn])
        got[r.conn].append(bytes(r.frame))
    assert got == want
    rng.shuffle(rows)
    rows += rows[:5]
    df = batches(spark, rows, schema, tmp_path, cuts(len(rows), 4, seed)).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    out = sorted((r.conn, r.n, bytes(r.frame)) for r in run(live.assembled(df), tmp_path, "out").collect())
    assert out == sorted((c, n, f) for c, fs in want.items() for n, f in enumerate(fs))


def test_cut():
    one, two = (1).to_bytes(4, "little") + bytes(16), (2).to_bytes(4, "little") + bytes(60)
    assert connections.cut(b"") == ([], b"", False)
    assert connections.cut(one + two + one[:19]) == ([one, two], one[:19], False)
    assert connections.cut(one + (4).to_bytes(4, "little") + bytes(15)) == ([one], (4).to_bytes(4, "little") + bytes(15), False)
    assert connections.cut(one + (4).to_bytes(4, "little") + bytes(16) + one) == ([one], b"", True)


def asked_and_answered(seed, n=300):
    r = random.Random(seed)
    tile = lambda: ("s", 9, 8 * r.randrange(4), 0)
    asked = [(i, *tile(), 1_700_000_000_000_000 + r.randrange(120_000_000)) for i in range(n)]
    given = [(*tile(), 1_700_000_000_000_000 + r.randrange(120_000_000)) for _ in range(n // 8)]
    given += [(s, z, x, y, us + d) for (_, s, z, x, y, us), d in zip(asked[:9], (0, 3_000_000, 3_000_001) * 3, strict=True)]
    want = {i: min((g[4] for g in given if g[:4] == k and us <= g[4] <= us + 3_000_000), default=None) for i, *k4, us in asked for k in [tuple(k4)]}
    return asked, given, want


def test_answers_in_time(spark, tmp_path):
    asked, given, want = asked_and_answered(4)
    a, g = "req_id long, style string, z int, mx long, my long, us long", "style string, z int, mx long, my long, us long"
    got = connections.answered(spark.createDataFrame(asked, a), spark.createDataFrame(given, g), KEY)
    assert {r.req_id: r.answered_us for r in got.collect()} == want
    assert None in want.values() and any(want.values())
    end = 1_700_000_300_000_000
    streams = [batches(spark, sorted(rows, key=lambda x: x[-1]) + [last], s, tmp_path, [*cuts(len(rows), 3, 5), 1], name).withColumn("ts", F.timestamp_micros("us")) for rows, s, name, last in ((asked, a, "a", (-1, "t", 1, 0, 0, end)), (given, g, "g", ("t", 1, 0, 0, end)))]
    out = run(live.answered(*streams, KEY), tmp_path, "out").where("req_id >= 0").groupBy("req_id").agg(F.min(F.unix_micros("answered")).alias("us"))
    assert {r.req_id: r.us for r in out.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_coalescing(spark, tmp_path, seed):
    """Requests and ends of renders in shuffled batches, in the order of their batches; nothing is left when all is done."""
    r, rows, waiting, want = random.Random(seed), [], {}, []
    for seq in range(200):
        tile = ("s", 9, 8 * r.randrange(5), 0)
        req = None if r.random() < 0.2 else seq
        rows.append((seq, *tile, req))
    rows += [(200 + i, "s", 9, 8 * i, 0, None) for i in range(5)]
    for _, *tile, req in rows:
        w = waiting.setdefault(tuple(tile), [])
        if req is None:
            want += [(x, "answered") for x in w]
            w.clear()
        else:
            want.append((req, "waits" if w else "renders"))
            w.append(req)
    sizes, at, dealt = cuts(len(rows), 5, seed), 0, []
    for n in sizes:
        part = rows[at : at + n]
        r.shuffle(part)
        dealt += part
        at += n
    df = batches(spark, dealt, "seq long, style string, z int, mx long, my long, req_id long", tmp_path, sizes).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    left, out = state_rows(live.coalesced(df), tmp_path)
    assert sorted((x.req_id, x.outcome) for x in out.collect()) == sorted(want)
    assert left == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_of_polls(spark, tmp_path, seed):
    """Late and shuffled polls, a counter that went back: the differences of the polls in order."""
    r, rows, want = random.Random(seed), [], []
    for key in range(3):
        n = us = 0
        polls = []
        for i in range(30):
            n, us = (0, 0) if i == 17 else (n + r.randrange(50), us + r.randrange(10**6))
            polls.append((key, 1_700_000_000 + 60 * i + r.randrange(30), n, us))
        want += [(key, b[1], b[1] - a[1], b[2] - a[2], b[3] - a[3]) for a, b in zip(polls, polls[1:], strict=False)]
        rows += polls
    rows.sort(key=lambda x: x[1] + r.randrange(500))
    rows += [(9, 1_700_100_000, 1, 1), (9, 1_700_200_000, 1, 1)]
    df = batches(spark, rows, "key long, at long, n long, us long", tmp_path, [*cuts(len(rows) - 2, 6, seed), 1, 1]).select("key", F.timestamp_seconds("at").alias("poll"), "n", "us")
    got = run(live.deltas(df), tmp_path, "out").where("key < 9").select("key", F.unix_seconds("poll"), "seconds", "dn", "dus").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_statistics_survive_a_restart(spark, tmp_path):
    """Stopped and started from its checkpoint, and a batch that runs twice: totals since the start."""
    top = tmp_path / "in"
    as_lines = lambda b: b.agg(F.count("*").alias("n")).select(F.lit(0).alias("line_no"), F.concat(F.lit("n: "), F.col("n").cast("string")).alias("line"))

    def start():
        stream = spark.readStream.schema("id long").parquet(str(top))
        q = live.stats_file(stream, as_lines, str(tmp_path / "stats"), availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination()
        return (tmp_path / "stats").read_text()

    spark.range(50).write.parquet(str(top))
    assert start() == "n: 50\n"
    spark.range(20).write.mode("append").parquet(str(top))
    assert start() == "n: 70\n"
    (tmp_path / "c" / "commits" / "1").unlink()  # stopped after the file was written, before the batch was noted
    for crc in (tmp_path / "c" / "commits").glob(".1.crc"):
        crc.unlink()
    assert start() == "n: 70\n"
    spark.range(1).write.mode("append").parquet(str(top))
    assert start() == "n: 71\n"


def test_imports_while_a_stream_runs(spark, tmp_path):
    """Requests before and after an import, and before the server looks again."""
    ts = "timestamp_ntz"
    at = lambda s: f"2024-01-05 10:{s}"
    table = str(tmp_path / "imports")
    known = lambda rows: spark.createDataFrame(rows, "style string, at string, planet_ts string").selectExpr("style", f"cast(at as {ts}) at", f"cast(planet_ts as {ts}) planet_ts")
    known([("*", "2024-01-01 00:00:00", "2024-01-01 00:00:00")]).write.parquet(table)
    rows = [(1, "s", at("01:00")), (2, "s", at("07:00")), (3, "s", at("10:00")), (4, "t", at("10:00"))]
    out = {}

    def write(batch, batch_id):
        out.update({r.req_id: (str(r.planet_ts), r.expired) for r in batch.collect()})
        if batch_id == 0:  # the import at 10:06 is seen at 10:10
            known([("s", at("06:00"), at("00:00"))]).write.mode("append").parquet(table)

    df = batches(spark, rows, "req_id long, style string, t string", tmp_path, [1, 3]).selectExpr("req_id", "style", f"cast(t as {ts}) ts", f"cast('2024-01-04 00:00:00' as {ts}) mtime")
    q = live.judged(df, lambda: spark.read.parquet(table), write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    old = ("2024-01-01 00:00:00", False)
    assert out == {1: old, 2: old, 3: (at("00:00"), True), 4: old}
    whole = fr.with_import_then(df_batch(spark, rows, ts), spark.read.parquet(table))
    assert {r.req_id: str(r.planet_ts) for r in whole.collect()} == {k: v[0] for k, v in out.items()}


def df_batch(spark, rows, ts):
    return spark.createDataFrame(rows, "req_id long, style string, t string").selectExpr("req_id", "style", f"cast(t as {ts}) ts")


def test_routing_to_many_layers(spark):
    r = random.Random(5)
    bases = ["/", "", "/a", "/a/", "/a/b", "x"] + ["/" + "/".join(r.choice("abc") for _ in range(r.randint(1, 4))) + r.choice(["", "/", "d"]) for _ in range(200)]
    layers = [(i, b) for i, b in enumerate(bases)][6:] + [(500 + i, b) for i, b in enumerate(bases[:6])]
    urls = ["/" + "/".join(r.choice("abcd") for _ in range(r.randint(1, 5))) + r.choice(["", "/"]) for _ in range(300)] + ["", "/", "x/y", "y", "//a"]
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string")
    for some in (layers, layers[:-1], layers[:-6]):
        got = fr.first_match(df, spark.createDataFrame(some, "layer_no int, baseuri string")).collect()
        assert {x.url: x.layer_no for x in got} == {u: min((n for n, b in some if u.startswith(b)), default=None) for u in urls} | {None: None}
        assert len(got) == len(urls) + 1
