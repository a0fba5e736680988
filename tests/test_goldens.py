"""Golden values of addressing, projections, the queue, stores and configuration."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tileflow.constants import BRITISH_GRID, MERCATOR, PLATE_CARREE
from tileflow.functions import address as A
from tileflow.functions import web as W
from tileflow.operators import batch as B
from tileflow.operators import queue as Q
from tileflow.operators import throttle
from tileflow.operators.throttle import Bucket, Buckets
from tileflow.sources import config, metatile, stores, wire

C = F.col
E = 20037508.3428


@pytest.mark.parametrize(
    ("srs", "ax", "ay", "box", "rounded"),
    [
        (MERCATOR, 1, 1, (-E, -E, E, E), (19724422.0, 19724422.0, -19724422.0, -19724422.0)),
        (PLATE_CARREE, 2, 1, (-E, -10018754.1714, E, 10018754.1714), (19880965.0, 9862211.0, -19880965.0, -9862211.0)),
        (BRITISH_GRID, 1, 2, (0.0, 0.0, 700000.0, 1400000.0), (694531.0, 1394531.0, 5469.0, 5469.0)),
        ("", 1, 1, (-E, -E, E, E), (19724422.0, 19724422.0, -19724422.0, -19724422.0)),
    ],
)
def test_projection_bounds(spark, srs, ax, ay, box, rounded):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 10), (ax * 1024 - 8, ay * 1024 - 8, 10)], "x long, y long, z int")
    b = A.tile_bounds(A.projection(F.lit(srs)), C("x"), C("y"), C("z"))
    r = df.select("x", "z", *[c.alias(k) for k, c in b.items()]).orderBy("z", "x").collect()
    assert (r[0].minx, r[0].miny, r[0].maxx, r[0].maxy) == box
    assert (r[1].minx, round(r[1].miny), round(r[1].maxx), r[1].maxy) == (box[0], rounded[1], rounded[2], box[3])
    assert (round(r[2].minx), r[2].miny, r[2].maxx, round(r[2].maxy)) == (rounded[0], box[1], box[2], rounded[3])


def test_path_round_trip_and_options(spark):
    rng = random.Random(1)
    rows = [(z, rng.randrange(1 << z), rng.randrange(1 << z)) for z in range(21) for _ in range(5)]
    df = spark.createDataFrame(rows, "z int, x long, y long").withColumn("path", A.hashed_path(F.lit("/t"), F.lit("default"), C("z"), C("x"), C("y")))
    got = df.select("z", "x", "y", *[c.alias(f"p_{k}") for k, c in A.parse_path("/t", C("path")).items()]).collect()
    assert all((r.p_z, r.p_x, r.p_y, r.p_code) == (r.z, r.x & ~7, r.y & ~7, 0) for r in got)
    one = spark.range(1).select(A.hashed_path(F.lit("/t"), F.lit("default"), F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit("de")).alias("p")).first().p
    assert one == "/t/default/0/0/0/0/0/0.de.meta"


def test_benchmark_box(spark):
    px0, py0 = A.ll_to_pixel(F.lit(-0.5), F.lit(51.75), C("z"))
    px1, py1 = A.ll_to_pixel(F.lit(0.5), F.lit(51.25), C("z"))
    n = (F.floor(px1 / 256) - F.floor(px0 / 256) + 1) * (F.floor(py1 / 256) - F.floor(py0 / 256) + 1)
    got = {r.z: r.n for r in spark.range(0, 21).select(C("id").cast("int").alias("z")).select("z", n.alias("n")).collect()}
    assert [got[z] for z in (10, 12, 14, 16, 18, 20)] == [12, 120, 1702, 27048, 427780, 6821674]
    assert sum(got.values()) == 9100215


def test_expiry_stops_at_shared_metatiles(spark):
    lines = spark.createDataFrame([("16/56715/4908",), ("17/113420/9816",), ("18/226860/19632",), ("19/453726/39265",), ("z/x/y",)], "line string")
    got = {(r.z, r.mx, r.my) for r in B.expand(B.parse_zxy(lines), 0, 19).collect()}
    want = set()
    for z, x, y in ((16, 56715, 4908), (17, 113420, 9816), (18, 226860, 19632), (19, 453726, 39265)):
        x, y = x << (19 - z), y << (19 - z)
        for k in range(19, 2, -1):
            tile = (k, x & ~7, y & ~7)
            if tile in want:
                break
            want.add(tile)
            x, y = x >> 1, y >> 1
    assert got == want
    assert min(z for z, _, _ in got) == 3


def test_full_cover_reaches_all_descendants(spark):
    t = spark.createDataFrame([(2, 1, 1)], "z int, x long, y long")
    got = B.expand(t, 6, 6, full_cover=True).collect()
    assert {(r.mx, r.my) for r in got} == {(16, 16), (16, 24), (24, 16), (24, 24)}


@pytest.mark.parametrize("seed", range(4))
def test_admission_equals_replay(spark, seed):
    rng = random.Random(seed)
    cmds = list(Q.QUEUE_OF)
    rows = [(i, "s", 12, rng.randrange(40) * 8, rng.randrange(30) * 8, rng.choice(cmds)) for i in range(1500)]
    df = spark.createDataFrame(rows, "req_id long, style string, z int, mx long, my long, cmd string")
    # caps so that nothing is dropped
    want = dict(Q.replay(((i, (s, z, x, y), c) for i, s, z, x, y, c in rows), 50, 5000))
    got = {r.req_id: r.reply for r in Q.replies(Q.admission(df, 50, 5000)).collect()}
    assert got == want


@pytest.mark.parametrize(("seed", "req_limit", "dirty_limit"), [(s, r, d) for s in range(3) for r, d in ((3, 10), (20, 5), (8, 60), (1, 100), (8, 0))])
def test_admission_equals_replay_with_drops(spark, seed, req_limit, dirty_limit):
    """Rare commands leave queues with room after Dirty is full, so metatiles once dropped come in later."""
    rng = random.Random(100 + seed)
    cmds = [*["Dirty", "RenderPrio"] * 8, *Q.QUEUE_OF]
    rows = [(i, "s", 12, rng.randrange(25) * 8, rng.randrange(12) * 8, rng.choice(cmds)) for i in range(1200)]
    df = spark.createDataFrame(rows, "req_id long, style string, z int, mx long, my long, cmd string")
    q = Q.RenderQueue(req_limit, dirty_limit)
    want, dropped = {}, 0
    for i, s, z, x, y, c in rows:
        was = q.dropped
        reply = q.add((s, z, x, y), c, i)
        dropped += q.dropped - was
        want[i] = (reply, q.dropped > was)
    got = Q.admission(df, req_limit, dirty_limit)
    replies = {r.req_id: r.reply for r in Q.replies(got).collect()}
    assert replies == {i: reply for i, (reply, _) in want.items()}
    assert {r.req_id for r in got.where("queue = 'Dropped'").collect()} == {i for i, (_, d) in want.items() if d}
    assert dropped > 0


def test_admission_drops(spark):
    rows = [(i, "s", 12, i % 900 * 8, 0, "RenderPrio") for i in range(1800)]
    df = spark.createDataFrame(rows, "req_id long, style string, z int, mx long, my long, cmd string")
    got = Q.admission(df, 256, 500)
    assert {r["queue"]: r["n"] for r in got.where("req_id = first_req").groupBy("queue").agg(F.count("*").alias("n")).collect()} == {"Prio": 256, "Dirty": 500, "Dropped": 144}
    assert got.where("queue = 'Dropped'").count() == 288


@pytest.mark.parametrize("size", [70, 5000])
def test_replay_in_slices_equals_replay(spark, size):
    """Slices of requests one after the other, with drops, styles that are null and metatiles asked for in many slices."""
    rng = random.Random(7)
    cmds = [*["Dirty", "RenderPrio"] * 3, *Q.QUEUE_OF]
    rows = [(i, rng.choice(["s", None]), 12, rng.randrange(20) * 8, rng.randrange(20) * 8, rng.choice(cmds)) for i in range(900)]
    events = [e for i, s, z, x, y, c in rows for e in [(i, (s, z, x, y), c), *([(i, None, "Fetch")] if i % 3 == 2 else [])]]
    q = Q.RenderQueue(6, 40)
    want = Q.replay(events, queue=q)
    df = spark.createDataFrame(rows, "req_id long, style string, z int, mx long, my long, cmd string").repartition(3)
    got = Q.replayed(df, F.col("req_id") % 3 == 2, 6, 40, size=size).collect()
    assert sorted((r.req_id, r.outcome) for r in got) == sorted(want)
    assert q.dropped > 0


def test_cancel_looks_at_its_own_items_alone():
    """Cancels that went through all that was ever fetched made the replay quadratic."""

    class Unlisted(OrderedDict):
        def values(self):
            raise AssertionError("all items are gone through")

    q = Q.RenderQueue()
    q.queues = {k: Unlisted() for k in q.queues}
    for fd, c in ((1, "Render"), (2, "RenderLow")):
        q.add(("s", 10, fd, 0), c, fd)
    q.cancel(1)
    q.cancel(2)
    assert [q.pending["s", 10, fd, 0]["fds"] for fd in (1, 2)] == [[-1], [2]]
    assert [q.fetch()[2], q.fetch()[2]] == [1, 2]
    q.cancel(2)
    assert [q.done(("s", 10, fd, 0), 0) for fd in (1, 2)] == [[-1], [-1]]
    assert not q.waits


@pytest.mark.parametrize("seed", range(2))
def test_exact_throttle_equals_the_replay(spark, seed):
    """Clients run through apart from each other, with the top-ups of all, many of them within the seconds a client is held."""
    rng = random.Random(seed)
    cfg = W.ServerConfig(enable_tile_throttling=True, delaypool_tile_size=3, delaypool_render_size=2, delaypool_tile_rate=20_000_000, delaypool_render_rate=70_000_000)
    rows = [(i, rng.choice([*"abcdefgh", None]), rng.randrange(400) * 500_000, rng.random() < 0.4) for i in range(500)]
    rows.sort(key=lambda r: (r[2], r[0]))
    b = Buckets(cfg, rows[0][2])
    want = {i: b.allow(c, us, missing) for i, c, us, missing in rows}
    df = spark.createDataFrame(rows, "req_id long, client_ip string, us long, missing boolean").repartition(3)
    plan = throttle.exact(df, cfg)
    assert {r.req_id: r.allowed for r in plan.collect()} == want
    assert {False, True} == set(want.values())
    assert "Coalesce" not in plan._jdf.queryExecution().toString()


def test_top_up_is_not_taken_back():
    """Held clients top up at a later time than the next request's; the tokens given then are not given again."""
    b = Buckets(W.ServerConfig(enable_tile_throttling=True, delaypool_tile_size=1, delaypool_render_size=1, delaypool_tile_rate=100_000_000, delaypool_render_rate=100_000_000), 0)
    for c in "ab":
        assert b.allow(c, 1, False)
        assert b.allow(c, 2, False)
    assert b.allow("a", 98_000_000, False)  # due at 100 s, when it was held for three
    assert b.tile_fill == 100_000_000
    assert b.allow("b", 98_000_001, False)  # its share of it
    assert not b.allow("b", 98_000_002, False)


def test_queue_order_and_dedup():
    q = Q.RenderQueue()
    for i, c in enumerate(("Render", "RenderBulk", "Dirty", "RenderPrio", "RenderLow")):
        q.add(("s", 10, i, 0), c, i)
    assert [q.fetch()[2] for _ in range(5)] == [3, 0, 4, 2, 1]
    assert q.fetch() is None
    assert q.add(("s", 10, 0, 0), "RenderPrio", 9) == "Ignore"
    assert q.done(("s", 10, 0, 0), 5) == [0, 9]
    assert q.add(("s", 10, 0, 0), "Dirty", 1) == "NotDone"
    assert q.add(("s", 10, 0, 0), "Render", 2) == "NotDone"


def test_queue_overflow_and_cancel():
    q = Q.RenderQueue()
    replies = [q.add(("s", 10, i, 0), "RenderPrio", i) for i in range(2 * 256 + 8000 + 1)]
    assert replies.count("Ignore") == 256
    assert len(q.queues["Dirty"]) == 8000
    assert q.dropped == 257
    q = Q.RenderQueue()
    for fd, c in enumerate(("Render", "RenderPrio", "RenderBulk", "RenderPrio", "RenderLow"), 1):
        q.add(("s", 10, fd, 0), c, fd)
    for fd in (2, 4, 5):
        q.cancel(fd)
    got = {}
    while (k := q.fetch()) is not None:
        got[k[2]] = q.done(k, 0)
    assert got == {1: [1], 2: [-1], 3: [3], 4: [-1], 5: [5]}


def test_buckets():
    cfg = W.ServerConfig(delaypool_tile_size=2, delaypool_render_size=1, delaypool_tile_rate=10_000_000, delaypool_render_rate=10**12)
    b = Buckets(cfg, 0)
    assert b.allow("a", 0, True)  # makes the bucket, free
    assert b.allow("a", 0, True)
    assert not b.allow("a", 0, True)  # no render left: takes the last tile, too
    assert b.users["a"][0] == 0
    assert not b.allow(None, 0, False)
    assert Buckets(cfg, 0, frozenset(["w"])).allow("w", 0, True)
    one = Bucket(cfg)
    assert [one.allow(0, False) for _ in range(3)] == [True, True, False]
    assert one.allow(10_000_000, False)


def test_container_round_trip(spark):
    tiles = {(x & 7) * 8 + (y & 7): f"tile of column {x} and row {y}".encode() for x in range(4) for y in range(8)}
    for packed in (False, True):
        blob = metatile.pack(1024, 1024, 10, tiles, packed)
        df = spark.createDataFrame([(x, y, bytearray(blob)) for x in range(8) for y in range(8)], "x long, y long, blob binary")
        for r in metatile.read_tiles(df).collect():
            size, data, z = metatile.unpack(blob, r.x, r.y)
            assert (r.status, bytes(r.data), r.compressed) == (size, data, z)
            assert (size == 0) == (r.x >= 4)
    assert metatile.decoded(spark.createDataFrame([(bytearray(metatile.pack(0, 0, 3, tiles)),)], "blob binary")).where("size > 0").count() == 32


def test_wire_versions(spark):
    df = spark.createDataFrame([("Render", -1, 5, 3, "ä" * 30, "image/png", "de")], "cmd string, x long, y long, z int, style string, mimetype string, options string")
    sizes = {}
    for ver in (1, 2, 3):
        f = df.select(wire.encode(C("cmd"), C("x"), C("y"), C("z"), C("style"), C("mimetype"), C("options"), ver).alias("frame"))
        sizes[ver] = len(f.first().frame)
        r = wire.upgraded(wire.decode(f)).first()
        assert (r.ver, r.cmd, r.x, r.y, r.z, r.rejected) == (ver, "Render", -1, 5, 3, False)
        assert (r["style"], r.options) == {1: ("default", ""), 2: ("ä" * 20, ""), 3: ("ä" * 20, "de")}[ver]
    assert sizes == {1: 20, 2: 64, 3: 144}


def test_stores(tmp_path, spark):
    assert stores.open_store(str(tmp_path)).kind == "file"
    assert stores.open_store(str(tmp_path / "none")) is None
    assert stores.open_store("ftp://x") is None
    assert stores.open_store("") is None
    for uri in ("ro_http_proxy://h", "composite:{a,/x}{b,/y}"):
        for change in ("write", "delete", "expire"):
            with pytest.raises(stores.ReadOnlyStore):
                getattr(stores.open_store(uri), change)(spark.range(1))
    stores.open_store("null://").write(spark.range(1))


def _some_tiles(spark):
    rows = [("s", 10, 8 * i, 16, 8 * i + k, 16 + k, f"tile {i} {k}".encode()) for i in range(4) for k in range(3)]
    return spark.createDataFrame(rows, "style string, z int, mx long, my long, x long, y long, data binary")


@pytest.mark.parametrize("uri", ["file", "memcached://", "rados://pool/etc/x"])
def test_store_operations(spark, tmp_path, uri):
    """Written tiles are read and stated, deleted ones are gone, expired ones are old or marked, written again they are fresh."""
    import datetime as dt

    tiles = _some_tiles(spark)
    blobs = metatile.encoded(tiles, ["style", "z", "mx", "my"]).withColumn("mtime", F.expr("TIMESTAMP_NTZ '2024-02-29 10:00:00'"))
    store = stores.FileStore(str(tmp_path), now="2024-03-01 00:00:00") if uri == "file" else stores.open_store(uri, tables=str(tmp_path))
    store.write(blobs)
    store.write(blobs)
    asked = tiles.select("style", "z", "x", "y", "data").withColumnRenamed("data", "want").unionByName(spark.createDataFrame([("s", 10, 0, 23, None), ("s", 10, 800, 800, None)], "style string, z int, x long, y long, want binary"))
    asked = asked.unionByName(asked)
    got = store.read(asked).collect()
    assert len(got) == 28
    for r in got:
        want = r.want if r.want is not None else (b"" if r.x == 0 else None)
        assert (r.data, r.status, r.compressed) == (want, -1 if want is None else len(want), None if want is None else False)
    stat = {(r.x, r.y): r for r in store.stat(asked).collect()}
    whole = {r.mx: r.n for r in blobs.select("mx", F.length("blob").alias("n")).collect()}
    assert all(r.size == (-1 if x == 800 else whole[x & ~7] if uri == "file" else len(r.want or b"")) for (x, _), r in stat.items())
    assert stat[8, 16].mtime == dt.datetime(2024, 2, 29, 10)
    gone = blobs.where("mx = 8")
    store.delete(gone)
    store.delete(gone)
    store.expire(blobs.where("mx >= 8 AND mx <= 16").unionByName(blobs.where("mx = 16")))
    stat = {r.x: r for r in store.stat(asked.where("y = 16")).collect()}
    assert [stat[x].size >= 0 for x in (0, 8, 16, 24)] == [True, False, True, True]
    assert store.read(asked.where("x = 8 AND y = 16")).first().status == -1
    if uri == "file":
        assert [stat[x].mtime.year for x in (0, 16, 24)] == [2024, 2004, 2024]
    else:
        assert [stat[x].expired for x in (0, 8, 16, 24)] == [False, False, True, False]
    store.write(blobs.where("mx <= 16"))
    stat = {r.x: r for r in store.stat(asked.where("y = 16")).collect()}
    assert all(stat[x].size >= 0 and not stat[x].expired and stat[x].mtime.year == 2024 for x in (0, 8, 16))
    place = store.storage_id(asked.where("x = 9")).first().storage_id
    assert place == {"file": f"file://{tmp_path}/s/10/0/0/0/1/128.meta", "memcached://": "memcached:///s/9/17/10.meta", "rados://pool/etc/x": "rados://pool/s/10/8/16.meta"}[uri]
    store.close()


def test_proxy_composite_and_null(spark, tmp_path):
    tiles = _some_tiles(spark)
    answers = tiles.select(F.concat(F.lit("/s/10/"), C("x").cast("string"), F.lit("/"), C("y").cast("string"), F.lit(".png")).alias("path"), F.when(C("x") < 16, 200).otherwise(404).alias("http"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("last_modified"), C("data").alias("body"))
    proxy = stores.open_store("ro_http_proxy://h", responses=answers)
    asked = tiles.select("style", "z", "x", "y")
    assert {r.x: (r.size >= 0, r.expired) for r in proxy.stat(asked).collect()} == {x: (x < 16, False) for x in (8 * i + k for i in range(4) for k in range(3))}
    over = metatile.encoded(tiles.where("mx = 0").withColumn("style", F.lit("o")), ["style", "z", "mx", "my"])
    store = stores.open_store("composite:{s,memcached://a}{o,memcached://b}", tables=str(tmp_path))
    store.lower.write(metatile.encoded(tiles, ["style", "z", "mx", "my"]))
    store.upper.write(over)
    got = {r.x: (r.status, r.data, r.over) for r in store.read(asked.where("y = 16")).collect()}
    assert got[0] == (8, b"tile 0 0", b"tile 0 0")
    assert {x: s for x, (s, _, _) in got.items()} == {0: 8, 8: -1, 16: -1, 24: -1}
    assert all(r.size > 0 for r in store.stat(asked).collect())
    null = stores.open_store("null://")
    for change in (null.write, null.delete, null.expire):
        change(asked)
    assert {(r.size, r.expired) for r in null.stat(asked).collect()} == {(-1, True)}
    assert {r.status for r in null.read(asked).collect()} == {-1}
    assert [s.storage_id(asked.limit(1)).first().storage_id for s in (null, store)] == ["null://", "Coposite tile"]


def test_layer_defaults_and_errors(spark):
    r = config.layers(spark, "[daemon]\n[Default]\nuri=/map\n").first()
    assert (r.baseuri, r.minzoom, r.maxzoom, r.output_format, r.scale) == ("/map/", 0, 20, "png256", 1.0)
    for bad in ("[a]\n", "[daemon]\n[daemon0]\n", "[daemon]\n[a]\nmaxzoom=21\n", "[daemon]\n[a]\nminzoom=5\nmaxzoom=4\n", "[daemon]\n[a]\ntype=png\n", "[daemon]\n[a]\ntype=a b c d\n", "[daemon]\n[a]\nscale=9\n", "[daemon]\n[a]\nmaxzoom=x\n", "[daemon9]\n", "[daemon]\n[a]\n[a]\n", "[daemon]\n" + "".join(f"[m{i}]\n" for i in range(101))):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_server_merge():
    assert W.ServerConfig().merged({"max_load_old": 0}).max_load_old == 0
    with pytest.raises(ValueError, match="unknown"):
        W.ServerConfig().merged({"nope": 1})


@pytest.mark.parametrize("args", [(5, 4, {}, {}), (0, 21, {}, {}), (1, 2, {}, {"min_x": 0}), (3, 3, {}, {"max_x": 8}), (3, 3, {}, {"min_x": 4, "max_x": 2}), (1, 2, {"min_lon": 1, "max_lon": 0, "min_lat": 0, "max_lat": 1}, {}), (3, 3, {"min_lon": 0, "max_lon": 1, "min_lat": 0, "max_lat": 1}, {"min_x": 1})])
def test_ranges_refused(args):
    with pytest.raises(ValueError):
        B.check_range(*args)


def test_throttled_servers_answer_503(spark):
    cfg = W.ServerConfig(enable_tile_throttling=True)
    out = W.serve_decision(F.lit("current"), F.lit(0.0), F.lit(True), cfg, C("ok"))
    got = spark.createDataFrame([(True,), (False,)], "ok boolean").select("ok", *[c.alias(k) for k, c in out.items()]).collect()
    assert {(r.ok, r.result, r.counter) for r in got} == {(True, "served", "FRESH"), (False, "503", None)}


def test_localized_query(spark):
    sql = "(select way,name,x from t) as q"
    got = spark.createDataFrame([(sql,)], "s string").select(W.localized_query(C("s"), "de,_").alias("q")).first().q
    assert got == "(select way, coalesce(tags->'name:de', name) as name,x from t) as q"


def test_metrics_text(tmp_path):
    from tileflow.streaming.live import write_text

    write_text(["a: 1", "b: 2"], str(tmp_path / "s"))
    assert (tmp_path / "s").read_text() == "a: 1\nb: 2\n"
    assert len(list(tmp_path.iterdir())) == 1


def test_counters_add_up_since_the_start():
    from tileflow.streaming.live import added_up

    total = {}
    assert added_up(total, ["a: 1", "b x: 2"]) == ["a: 1", "b x: 2"]
    assert added_up(total, ["b x: 3", "c: 0"]) == ["a: 1", "b x: 5", "c: 0"]


def test_parameterisations(spark):
    sql = spark.createDataFrame([("(select way,name,x from t) as q",)], "s string")
    assert "tags->'name:de'" in sql.select(W.parameterized("language", C("s"), "de,_")).first()[0]
    with pytest.warns(UserWarning, match="unknown"):
        assert sql.select(W.parameterized("colour", C("s"), "de")).first()[0] == "(select way,name,x from t) as q"
    assert sql.select(W.parameterized("", C("s"), "de")).first()[0] == "(select way,name,x from t) as q"


def test_renderer_slot(spark):
    from tileflow.operators.render import plain, rendered

    metatiles = spark.createDataFrame([("s", 1, 0, 0), ("s", 12, 8, 16), ("bad", 12, 8, 16)], "style string, z int, mx long, my long")
    assert sorted(plain("s", 1, 0, 0, "")) == [0, 1, 8, 9]
    got = {(r["style"], r.z): r for r in rendered(metatiles).collect()}
    assert metatile.unpack(bytes(got["s", 12].blob), 9, 18)[1] == b"s/12/9/18"
    assert rendered(metatiles).select("blob").exceptAll(rendered(metatiles.repartition(3)).select("blob")).count() == 0

    def fails(style, z, mx, my, options):
        if style == "bad":
            raise ValueError("no such style")
        return {0: b"x"}

    got = {r["style"]: r for r in rendered(metatiles.where("z = 12"), fails).collect()}
    assert (got["bad"].blob, got["bad"].error) == (None, "ValueError: no such style")
    assert metatile.unpack(bytes(got["s"].blob), 8, 16)[0] == 1


def test_sql_table_to_files(spark, tmp_path):
    """Rows of a SQL table read by jdbc in parts, exported as files that carry the rows' times."""
    import datetime as dt

    from tileflow.sources import tables

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(3, i, i + 1, "" if i % 3 == 0 else f"tile {i}", f"2023-0{1 + i % 9}-28 12:00:0{i % 10}" if i else "soon") for i in range(20)]
    df = spark.createDataFrame(rows, "z int, x int, y int, data string, created string")
    df.write.jdbc(url, "tiles", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    back = tables.read_table(spark, url, "tiles", split_by="x", bounds=(0, 20), parts=3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.rdd.getNumPartitions() == 3
    back = back.withColumn("created_at", tables.parsed_time(C("created")))
    assert back.where("created_at IS NULL").select("x").collect() == [(0,)]
    tables.export(back, str(tmp_path / "out"))
    files = sorted(p for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert len(files) == 13
    one = tmp_path / "out" / "3" / "4" / "5.png"
    assert one.read_bytes() == b"tile 4"
    assert dt.datetime.fromtimestamp(one.stat().st_mtime, dt.UTC).replace(tzinfo=None) == dt.datetime(2023, 5, 28, 12, 0, 4)


def test_rates_and_buckets():
    cfg = W.ServerConfig().throttled(tiles=(10, 4.0), renders=(3, 0.5))
    assert (cfg.delaypool_tile_size, cfg.delaypool_tile_rate, cfg.delaypool_render_size, cfg.delaypool_render_rate) == (10, 250_000, 3, 2_000_000)
    assert W.ServerConfig().throttled().delaypool_tile_rate == W.ServerConfig().delaypool_tile_rate
    with pytest.raises(ValueError, match="rate"):
        W.top_up_us(0)


def test_work_order_and_back_off(spark):
    df = spark.createDataFrame([(3, 8, 0), (12, 0, 8), (5, 0, 0), (3, 0, 0)], "z int, mx long, my long")
    assert [(r.z, r.mx) for r in B.in_order(df).collect()] == [(3, 0), (3, 8), (5, 0), (12, 0)]
    assert [r.z for r in B.in_order(df, expiry=True).collect()] == [12, 5, 3, 3]
    loads, slept = iter([20.0, 16.0, 15.9]), []
    assert B.wait_for_load(lambda: next(loads), 16, slept.append) == 2
    assert slept == [5.0, 5.0]


def test_switched_off_handlers(spark):
    layer = {"baseuri": F.lit("/t/"), "ext": F.lit("png"), "minzoom": F.lit(0), "maxzoom": F.lit(20), "aspect_x": F.lit(1), "aspect_y": F.lit(1)}
    urls = spark.createDataFrame([("/t/1/0/0.png/status",), ("/t/1/0/0.png/dirty",), ("/metrics",), ("/server_stats",), ("/t/1/0/0.png",)], "url string")
    on, off = W.ServerConfig(), W.ServerConfig().merged({"enable_dirty_url": False, "enable_status_url": False, "enable_global_stats": False})
    got = [[r.h for r in urls.select(W.route(C("url"), layer, cfg=c)["handler"].alias("h")).collect()] for c in (on, off)]
    assert got == [["status", "dirty", "metrics", "stats", "serve"], ["notfound", "notfound", "error", "error", "serve"]]


def test_numbered(spark):
    from tileflow.operators.freshness import numbered

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), i) for i in rng.sample(range(5000), 700)]
    got = {(r.g, r.o): r.arrival for r in numbered(spark.createDataFrame(rows, "g string, o long"), "g", "o").collect()}
    want = {}
    for g in ("a", "b", "c", None):
        want |= {(g, o): n for n, o in enumerate(sorted(o for k, o in rows if k == g), 1)}
    assert got == want
