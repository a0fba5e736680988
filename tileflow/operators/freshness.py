"""Requests joined to what a store knows of their tiles.

Store tables and styles are joined by equality and the engine picks the strategy by their size;
only single rows are broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileflow.constants import XMLCONFIGS_MAX
from tileflow.functions import web
from tileflow.sources import shared

KEY = ["style", "z", "mx", "my"]


def with_planet_time(rows: DataFrame, planet_times: DataFrame, now: str) -> DataFrame:
    """planet_ts of the row's style, else of all styles ('*'), else three days before now."""
    own = planet_times.where("style <> '*'").select(F.col("style").alias("p_style"), F.col("planet_ts").alias("own_ts"))
    overall = planet_times.where("style = '*'").agg(F.max("planet_ts").alias("all_ts"))
    r = rows.join(own, F.col("style") == F.col("p_style"), "left").join(F.broadcast(overall), how="left")
    last = F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL 3 DAYS")
    return r.withColumn("planet_ts", F.coalesce("own_ts", "all_ts", last)).drop("p_style", "own_ts", "all_ts")


def with_stat(requests: DataFrame, cache: DataFrame, planet_times: DataFrame, now: str) -> DataFrame:
    """Requests with size (-1 if missing), mtime and planet_ts of their metatile."""
    stat = cache.select(*KEY, "size", "mtime")
    return with_planet_time(requests.join(stat, KEY, "left").withColumn("size", F.coalesce("size", F.lit(-1).cast("long"))), planet_times, now)


def with_state(requests: DataFrame, cache: DataFrame, planet_times: DataFrame, now: str, very_old_us: int) -> DataFrame:
    r = with_stat(requests, cache, planet_times, now)
    return r.withColumn("state", web.tile_state(F.col("size"), F.col("mtime"), F.col("planet_ts"), timestamp(now), very_old_us))


def timestamp(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def first_match(urls: DataFrame, layers: DataFrame) -> DataFrame:
    """Each url with the first layer whose base it begins with; nulls if none.

    Up to 100 layers (counted) travel as one array, so requests are neither shuffled nor multiplied; more are found by ``_by_prefix``.
    """
    if layers.limit(XMLCONFIGS_MAX + 1).count() > XMLCONFIGS_MAX:
        return _by_prefix(urls, layers)
    rest = [c for c in layers.columns if c != "layer_no"]
    known = layers.agg(F.sort_array(F.collect_list(F.struct("layer_no", *rest))).alias("known"))
    found = urls.join(F.broadcast(known)).withColumn("layer", F.try_element_at(F.filter("known", lambda x: F.startswith(F.col("url"), x["baseuri"])), F.lit(1)))
    return found.select(*urls.columns, *[F.col(f"layer.{c}").alias(c) for c in layers.columns])


def _by_prefix(urls: DataFrame, layers: DataFrame) -> DataFrame:
    """The same for any number of layers. A base's folder, up to its last slash, is one of the folders of every url that begins with it:
    distinct urls meet layers by equality, once for each of their folders."""
    folder = F.regexp_extract("baseuri", "^(.*/)?", 0)
    base = layers.groupBy("baseuri").agg(F.min("layer_no").alias("n")).select("baseuri", "n", folder.alias("folder"))
    part = F.split("url", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda i: F.concat(F.array_join(F.slice(part, 1, i), "/"), F.lit("/")))
    each = urls.select("url").distinct().select("url", F.explode(F.concat(F.array(F.lit("")), F.when(F.size(part) > 1, folders).otherwise(F.array()))).alias("folder"))
    hit = each.join(base, "folder").where(F.startswith("url", "baseuri")).groupBy(F.col("url").alias("hit_url")).agg(F.min("n").alias("n"))
    hit = shared.staged(hit.join(layers, F.col("n") == F.col("layer_no")).select("hit_url", *layers.columns), "routes")
    return urls.join(hit, F.col("url") == F.col("hit_url"), "left").select(*urls.columns, *layers.columns)


def with_import_then(rows: DataFrame, imports: DataFrame, refresh: int = 300) -> DataFrame:
    """rows(style, ts, ..) with planet_ts as a server knew it at ts: it looks for the last import of the style, or else of all styles ('*'),
    every ``refresh`` seconds, and takes three days before that look where there is none. imports(style, at, planet_ts).

    Between two looks all rows know the same, so the last import is carried over the distinct looks of a style, and rows meet these by
    equality.
    """
    look = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (refresh * 1_000_000)).cast("long")
    seen = F.ceil(F.unix_micros(F.col("at").cast("timestamp")) / (refresh * 1_000_000)).cast("long")
    known = imports.groupBy("style", seen.alias("look")).agg(F.max_by("planet_ts", "at").alias("planet_ts"))
    own = rows.select("style", look("ts").alias("look")).distinct()
    every = own.select(F.lit("*").alias("style"), "look").distinct()
    asked = own.unionByName(every).withColumn("planet_ts", F.lit(None).cast(imports.schema["planet_ts"].dataType)).withColumn("asked", F.lit(True))
    until = Window.partitionBy("style").orderBy("look", F.col("planet_ts").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = known.withColumn("asked", F.lit(False)).unionByName(asked).withColumn("last", F.last("planet_ts", ignorenulls=True).over(until)).where("asked")
    one = carried.where("style <> '*'").select(F.col("style").alias("k_style"), F.col("look").alias("k_look"), F.col("last").alias("own_ts"))
    all_ = carried.where("style = '*'").select(F.col("look").alias("a_look"), F.col("last").alias("all_ts"))
    known = one.join(all_, F.col("k_look") == F.col("a_look"), "left")
    three = F.timestamp_seconds(F.col("k_look") * refresh - 3 * 86400).cast("timestamp_ntz")
    known = shared.staged(known.select("k_style", "k_look", F.coalesce("own_ts", "all_ts", three).alias("planet_ts")), "imports")
    return rows.join(known, (F.col("style") == F.col("k_style")) & (look("ts") == F.col("k_look")), "left").drop("k_style", "k_look")


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``arrival`` of each row within its group, from 1, without a task that holds a group: rows are sorted by ranges, numbered
    within a range, and the numbers shifted by what earlier ranges hold of the group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, order).sortWithinPartitions(group, order)
    dealt = shared.staged(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "numbered")
    held = dealt.groupBy("part", F.col(group).alias("in_group")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("in_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = shared.staged(held.select(F.col("part").alias("in_part"), "in_group", (earlier - F.col("first") + 1).alias("shift")), "shifts")
    out = dealt.join(held, (F.col("part") == F.col("in_part")) & F.col(group).eqNullSafe(F.col("in_group")))
    return out.select(*rows.columns, (F.col("place") + F.col("shift")).alias("arrival"))
