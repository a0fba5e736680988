"""Streams give what the batch forms give."""

import random

from pyspark.sql import functions as F

from tileflow.functions.web import ServerConfig
from tileflow.operators import queue as Q
from tileflow.operators.throttle import Bucket
from tileflow.sources import wire
from tileflow.streaming import live


def run(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / name))


def source(spark, df, tmp_path, name, files=1):
    df.repartition(files).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def test_throttled(spark, tmp_path):
    rng = random.Random(3)
    cfg = ServerConfig(delaypool_tile_size=3, delaypool_render_size=1, delaypool_tile_rate=1_000_000, delaypool_render_rate=2_000_000)
    rows = [(i, f"10.0.0.{rng.randrange(5)}", 1_700_000_000_000_000 + i * 150_000, rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "req_id long, client_ip string, us long, missing boolean")
    got = {r.req_id: r.allowed for r in run(live.throttled(source(spark, df, tmp_path, "in"), cfg), tmp_path, "out").collect()}
    buckets = {}
    want = {i: buckets.setdefault(c, Bucket(cfg)).allow(us, m) for i, c, us, m in rows}
    assert got == want
    assert 0 < sum(got.values()) < 300


def test_queued(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "s", 9, rng.randrange(20) * 8, 0, rng.choice([*Q.QUEUE_OF, "Fetch"])) for i in range(400)]
    df = spark.createDataFrame(rows, "req_id long, style string, z int, mx long, my long, cmd string")
    got = {r.req_id: r.outcome for r in run(live.queued(source(spark, df, tmp_path, "in")), tmp_path, "out").collect()}
    assert got == dict(Q.replay((i, (s, z, x, y), c) for i, s, z, x, y, c in rows))


def test_frames_and_stats(spark, tmp_path):
    r = spark.range(50).select(F.col("id").alias("req_id"), wire.encode(F.lit("Render"), F.col("id"), F.col("id"), F.lit(9), F.lit("s"), F.lit("image/png"), F.lit("")).alias("frame"))
    r.write.parquet(str(tmp_path / "frames"))
    stream = live.frames(spark, str(tmp_path / "frames"))
    as_lines = lambda b: b.agg(F.count("*").alias("n")).select(F.lit(0).alias("line_no"), F.concat(F.lit("n: "), F.col("n").cast("string")).alias("line"))
    q = live.stats_file(stream, as_lines, str(tmp_path / "stats"), availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert (tmp_path / "stats").read_text() == "n: 50\n"


def test_polled(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(3).alias("z"), F.lit(2).cast("long").alias("read_us"))
    q = live.polled(source(spark, df, tmp_path, "in")).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.agg(F.max("n_reads")).first()[0] == 5
    assert got.agg(F.sum("dur_us")).first()[0] >= 2 * 85
