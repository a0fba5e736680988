"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. A source that must give ``rem`` words
beyond its whole copies takes the documents whose hash lies below one threshold.
The threshold is found without sorting: sum words by source and leading hash bits,
find the bucket in which the running sum passes ``rem``, and look only into that
bucket with the next bits, until it holds one hash. Where several rows share that hash, they
are equal in id and text; a second hash, of the row's number in the staged table, splits them the
same way, so how many are taken is exact, and which of them makes no difference. Thresholds are
nested: a larger budget keeps all that a smaller one took, plus more.

Only DataFrame expressions run here. Sums are combined before they are shuffled, so a
source with most rows costs no more than any other; a running sum sees at most
``2**BITS`` rows of a source.

Defined results
    null text: size 0. Null source: a source of its own, last in order. Null or repeated ids: told
    apart by their texts; rows equal in id and text are split at the threshold. Empty table:
    an empty result. All sizes 0: targets 0, nothing taken. Columns of the input with names
    used here do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileflow.llm.scratch import stage

WORD_BREAKS = " \t\n\x0b\x0c\r"
HASH_BITS = 60
BITS = 10


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009..U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of an md5, the same in any engine; null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """id_hash of id and text together."""
    return id_hash(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes(source, source_size) -> with target.

    One row per source: the windows here order sources, never documents. A source is capped
    if its cap is below what its weight earns once all sources that reach their cap earlier
    have taken theirs.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("limit", (F.col("source_size") * cap).cast("long"))
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"all_size": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    w = w.withColumns({"used": F.coalesce(F.sum("limit").over(before), F.lit(0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0))})
    w = w.withColumn("capped", F.col("limit") * (F.col("all_w") - F.col("gone")) <= F.col("w") * (F.col("all_size") - F.col("used")))
    w = w.withColumns({"capped_size": F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(everything), F.lit(0)), "capped_w": F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0))})
    share = F.col("w") * (F.col("all_size") - F.col("capped_size")).cast("double") / (F.col("all_w") - F.col("capped_w"))
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc: all input columns, source, size, hk, row: a number of its own). To be staged before ``row`` is used."""
    return docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("hk"), F.monotonically_increasing_id().alias("row"))


def refined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, size, key: 60 bits), plan(source, rem) -> (source, rem, under: words below the boundary bucket, inside:
    words in it, lo and hi: its first key and the one after its last, n: its rows, more: whether they have several keys).

    Buckets get narrower by BITS a round, until the boundary bucket of every source holds one key."""
    nothing = [F.lit(0).cast("long").alias(c) for c in ("prefix", "under", "inside", "lo", "hi", "n")]
    state = stage(plan.select("source", "rem", *nothing, (F.col("rem") > 0).alias("more")), "mix-plan")
    for level in range(HASH_BITS // BITS):
        shift = HASH_BITS - BITS * (level + 1)
        live = state.where("more").select(F.col("source").alias("s"), F.col("rem").alias("r"), F.col("prefix").alias("p"), F.col("under").alias("u"))
        if live.isEmpty():
            break
        within = rows.join(live, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", shift + BITS) == F.col("p")))
        hist = within.groupBy("s", "r", "u", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("count"), F.min("key").alias("first"), F.max("key").alias("last"))
        upto = F.col("u") + F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        found = hist.withColumn("upto", upto).where((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("words") <= F.col("r")))
        found = found.select(F.col("s").alias("fs"), "bucket", (F.col("upto") - F.col("words")).alias("below"), "words", "count", "first", "last")
        hit = F.col("bucket").isNotNull()
        # no hit: every row of the source is below the threshold
        take = {"prefix": "bucket", "under": "below", "inside": "words", "n": "count"}
        cols = [F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in take.items()]
        cols += [F.when(hit, F.shiftleft("bucket", shift)).when(F.col("more"), F.lit(1 << HASH_BITS)).otherwise(F.col("lo")).alias("lo"), F.when(hit, F.col("last") + 1).otherwise(F.col("hi")).alias("hi")]
        joined = state.join(found, F.col("more") & F.col("source").eqNullSafe(F.col("fs")), "left")
        state = stage(joined.select("source", "rem", *cols, (hit & (F.col("first") < F.col("last"))).alias("more")), "mix-plan")
    return state


def thresholds(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """rows(source, size, hk, row), staged -> (source, source_size, target, whole, below, at, row_below): a row is taken
    ``whole`` times, and once more if hk < below, or if hk = at and the hash of its row number < row_below."""
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    plan = targets(sizes, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio + 1e-9).cast("long"))
    plan = stage(plan.withColumn("rem", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "mix-plan")
    first = refined(rows.select("source", "size", F.col("hk").alias("key")), plan)
    closer = (F.col("under") + F.col("inside") - F.col("rem")) < (F.col("rem") - F.col("under"))
    shared = F.col("n") > 1
    first = first.select(F.col("source").alias("s1"), F.when(~shared & closer & (F.col("n") > 0), F.col("hi")).otherwise(F.col("lo")).alias("below"), F.when(shared, F.col("hi") - 1).alias("at"), (F.col("rem") - F.col("under")).alias("left"))
    first = stage(first, "mix-plan")
    tied = first.where("at IS NOT NULL").select(F.col("s1").alias("source"), F.col("left").alias("rem"), "at")
    equal = rows.join(tied.select(F.col("source").alias("ts"), F.col("at").alias("hk_at")), F.col("source").eqNullSafe(F.col("ts")) & (F.col("hk") == F.col("hk_at")))
    second = refined(equal.select("source", "size", id_hash(F.col("row")).alias("key")), tied)
    second = second.select(F.col("source").alias("s2"), F.when(closer & (F.col("n") > 0), F.col("hi")).otherwise(F.col("lo")).alias("row_below"))
    out = plan.join(first, F.col("source").eqNullSafe(F.col("s1")), "left").join(second, F.col("source").eqNullSafe(F.col("s2")) & F.col("at").isNotNull(), "left")
    out = out.select("source", "source_size", "target", "whole", F.when(F.col("rem") > 0, F.col("below")).otherwise(F.lit(0)).cast("long").alias("below"), "at", F.coalesce("row_below", F.lit(0).cast("long")).alias("row_below"))
    return stage(out, "mix-plan")  # so its size is known: a row for each source, joined to the documents without moving them


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source and ``copies``, how often the mix takes them."""
    p = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    split = F.when(F.col("hk") == F.col("at"), id_hash(F.col("row")) < F.col("row_below"))
    return joined.withColumn("copies", F.col("whole") + F.coalesce(split, F.col("hk") < F.col("below")).cast("long"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: the input's columns, each document as often as it is taken."""
    rows = stage(measured(docs, id_col, text_col, source_col), "mix-documents")
    taken = mix(rows, thresholds(rows.select("source", "size", "hk", "row"), weights, cap)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(id, size, source_size, target, taken) for every document."""
    rows = measured(docs, id_col, text_col, source_col)
    rows = stage(rows.select(F.col(f"doc.{id_col}").alias("id"), "source", "size", "hk", "row"), "mix-rows")
    return mix(rows, thresholds(rows, weights, cap)).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  CAST(concat('0x', left(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))), 15)) AS BIGINT) AS hk FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w, 3 * source_size AS lim FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS t, CAST(sum(w) OVER () AS BIGINT) AS ws,
              CAST(coalesce(sum(lim) OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used,
              CAST(coalesce(sum(w) OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone FROM s1),
s3 AS (SELECT *, lim * (ws - gone) <= w * (t - used) AS capped FROM s2),
s4 AS (SELECT *, CAST(coalesce(sum(CASE WHEN capped THEN lim END) OVER (), 0) AS BIGINT) AS cs, CAST(coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS BIGINT) AS cw FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(lim AS DOUBLE) ELSE CAST(w * CAST(t - cs AS DOUBLE) / (ws - cw) AS DOUBLE) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM s5),
s7 AS (SELECT *, greatest(target - whole * source_size, 0.0) AS rem FROM s6),
r AS (SELECT doc_id, d.source, size, source_size, target, whole, rem, hk FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
g AS (SELECT source, hk, CAST(sum(size) AS BIGINT) AS n FROM r GROUP BY source, hk),
c AS (SELECT source, hk, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY hk) AS BIGINT) AS upto FROM g),
e AS (SELECT r.*, upto - n AS before, row_number() OVER (PARTITION BY r.source, r.hk) AS copy FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.hk = c.hk)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN rem > 0 AND (before + copy * size <= rem OR (before + (copy - 1) * size <= rem AND before + copy * size - rem < rem - (before + (copy - 1) * size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
