"""Quality rules with thresholds learned from mergeable quantile sketches.

Each document gets exact counts (words, symbols, repeated lines, words in repeated 5-word
windows). Two fixed base rules reject documents outright. The others adapt: every metric of
the documents that pass the base rules is sketched per language and source, fences are set
from the quartiles of that group, and the documents are joined to the fences of their group.

The sketch of a metric is a histogram over buckets whose width is 1/32 of the value or less:
sketches merge by adding counts, so they are built with partial aggregation, a group that
holds most rows costs no more than any other, and small groups (< ``MIN_GROUP``) use the
merged sketch of their language, or of everything, without reading a document again. A
quantile read from it is exact below 64 and within 1/32 above.

All of it is DataFrame and SQL expressions; windows of a text are compared inside its own
row, so nothing is exploded or shuffled by word.

Defined results
    null text: no words, so base_failed. Null language or source: groups of their own. Empty
    table: an empty result. Repeated rows: each is judged alone. Ties in a sketch share a
    bucket. A text is never truncated. Clashing input columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileflow.llm.scratch import stage

#: Documents from which a group's own thresholds count; a smaller one uses those of the merged sketches. Default of the parameter ``min_group``.
MIN_GROUP = 100
#: metric -> (numerator, denominator, scale, slack above the upper fence, whether it has a lower fence)
METRICS = {
    "symbols": ("n_symbols", "n_words", 1000, 100, False),
    "word_length": ("word_chars", "n_words", 100, 300, True),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 200, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, False),
}
SPREAD = 3


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    t = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    a = t.withColumn("w", F.expr(r"array_remove(split(translate(t, '\t\n\u000b\u000c\r', '     '), ' '), '')"))
    a = a.withColumn("n", F.expr("size(w)"))
    a = a.withColumn("win", F.expr("CASE WHEN n >= 5 THEN slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4))), 1, n - 4) ELSE array() END"))
    a = a.withColumn("lines", F.expr(r"filter(split(t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    a = a.select(
        "doc",
        F.col("n").cast("long").alias("n_words"),
        F.expr(r"CAST(length(t) - regexp_count(t, '[\\x20\\x09-\\x0D]') AS BIGINT)").alias("word_chars"),
        F.expr(r"CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(size(lines) AS BIGINT)").alias("n_lines"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr("CASE WHEN size(array_distinct(win)) < size(win) THEN array_sort(transform(win, (h, i) -> struct(h, i))) END").alias("placed"),
    )
    a = a.withColumn("at", F.expr("array_sort(transform(filter(placed, (p, j) -> coalesce(get(placed, j - 1).h = p.h, false) OR coalesce(get(placed, j + 1).h = p.h, false)), p -> p.i))"))
    covered = "aggregate(transform(at, (p, j) -> least(5, coalesce(get(at, j + 1) - p, 5))), 0L, (s, x) -> s + x)"
    return a.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).drop("placed", "at")


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def metric(name: str) -> str:
    top, bottom, scale, _, _ = METRICS[name]
    return f"({scale} * {top}) div greatest({bottom}, 1)"


def bucket(v: str) -> str:
    """Bucket of a non-negative integer: itself below 64, then its six leading bits and their shift."""
    e = f"(length(bin({v})) - 6)"
    return f"CASE WHEN {v} < 64 THEN {v} ELSE 64 * {e} + shiftright({v}, {e}) END"


def sketch(rows: DataFrame) -> DataFrame:
    """rows(lang, source, counts) -> (lang, source, metric, bucket, n)."""
    long = rows.select("lang", "source", F.expr("stack(%d, %s) AS (metric, v)" % (len(METRICS), ", ".join(f"'{m}', {metric(m)}" for m in METRICS))))
    return long.groupBy("lang", "source", "metric", F.expr(bucket("v")).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches up to ``keys`` -> (keys, docs, <metric>_lo, <metric>_hi)."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumns({"upto": F.sum("n").over(Window.partitionBy(*keys, "metric").orderBy("bucket")), "docs": F.sum("n").over(Window.partitionBy(*keys, "metric"))})
    e = "(bucket div 64)"
    run = run.withColumn("v", F.expr(f"CASE WHEN bucket < 64 THEN bucket ELSE shiftleft(bucket % 64 + 1, CAST({e} AS INT)) - 1 END"))
    q = run.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), *[F.min(F.expr(f"CASE WHEN 100 * upto >= {p} * docs THEN v END")).alias(f"q{p}") for p in (25, 50, 75)])
    slack, low = F.lit(0), F.lit(False)
    for m, (_, _, _, s, two_sided) in METRICS.items():
        slack, low = F.when(F.col("metric") == m, s).otherwise(slack), F.when(F.col("metric") == m, two_sided).otherwise(low)
    q = q.withColumns({"hi": F.col("q75") + SPREAD * (F.col("q75") - F.col("q50")) + slack, "lo": F.when(low, F.col("q25") - SPREAD * (F.col("q50") - F.col("q25")) - slack)})
    return q.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("lo", "hi")])


def verdicts(rows: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """rows(lang, source, counts..), staged -> with base_failed and kept."""
    rows = rows.withColumn("base_failed", F.expr(BASE_FAILED))
    sketches = stage(sketch(rows.where("NOT base_failed")), "rule-sketches")
    cols = [f"{m}_{side}" for m in METRICS for side in ("lo", "hi")]
    own, of_lang, of_all = (fences(sketches, k) for k in (["lang", "source"], ["lang"], []))
    of_lang = of_lang.select(F.col("lang").alias("l1"), F.col("docs").alias("docs1"), *[F.col(c).alias(f"{c}1") for c in cols])
    of_all = of_all.select(*[F.col(c).alias(f"{c}2") for c in cols])
    chosen = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l1")), "left").join(of_all, F.lit(True), "left")
    pick = lambda c: F.when(F.col("docs") >= min_group, F.col(c)).when(F.col("docs1") >= min_group, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    chosen = stage(chosen.select(F.col("lang").alias("fl"), F.col("source").alias("fs"), *[pick(c).alias(c) for c in cols]), "rule-fences")
    inside = " AND ".join(f"coalesce({metric(m)} <= {m}_hi, true) AND coalesce({metric(m)} >= {m}_lo, true)" for m in METRICS)
    joined = rows.join(chosen, F.col("lang").eqNullSafe(F.col("fl")) & F.col("source").eqNullSafe(F.col("fs")), "left")
    return joined.withColumn("kept", F.expr(f"NOT base_failed AND {inside}")).drop("fl", "fs", *cols)


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    rows = counted(docs, text_col)
    rows = stage(rows.select(F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{lang_col}").alias("lang"), F.col(f"doc.{source_col}").alias("source"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"), "rule-counts")
    return verdicts(rows, min_group).select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    m = {k: f"(({s} * {a}) // greatest({b}, 1))" for k, (a, b, s, _, _) in METRICS.items()}
    bk = "CASE WHEN v < 64 THEN v ELSE 64 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) END"
    slack = "CASE metric " + " ".join(f"WHEN '{k}' THEN {x[3]}" for k, x in METRICS.items()) + " END"
    two = "metric IN (" + ", ".join(f"'{k}'" for k, x in METRICS.items() if x[4]) + ")"
    cols = [f"{k}_{side}" for k in METRICS for side in ("lo", "hi")]

    def level(name: str, keys: str) -> str:
        k, p = (f"{keys}, " if keys else ""), f"{keys}, " if keys else ""
        group = f"GROUP BY {keys}" if keys else ""
        sides = ", ".join(f"max(CASE WHEN metric = '{x.rsplit('_', 1)[0]}' THEN {x.rsplit('_', 1)[1]} END) AS {x}" for x in cols)
        return f"""
{name}_m AS (SELECT {k}metric, bucket, sum(n) AS n FROM sk GROUP BY {k}metric, bucket),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {p}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {p}metric) AS docs,
  CASE WHEN bucket < 64 THEN bucket ELSE ((bucket % 64 + 1) << CAST(bucket // 64 AS INT)) - 1 END AS v FROM {name}_m),
{name}_q AS (SELECT {k}metric, max(docs) AS docs, min(CASE WHEN 100 * upto >= 25 * docs THEN v END) AS q25, min(CASE WHEN 100 * upto >= 50 * docs THEN v END) AS q50,
  min(CASE WHEN 100 * upto >= 75 * docs THEN v END) AS q75 FROM {name}_r GROUP BY {k}metric),
{name}_f AS (SELECT {k}metric, docs, q75 + {SPREAD} * (q75 - q50) + {slack} AS hi, CASE WHEN {two} THEN q25 - {SPREAD} * (q50 - q25) - {slack} END AS lo FROM {name}_q),
{name} AS (SELECT {k}max(docs) AS docs, {sides} FROM {name}_f {group})"""

    pick = ", ".join(f"CASE WHEN a.docs >= {MIN_GROUP} THEN a.{c} WHEN b.docs >= {MIN_GROUP} THEN b.{c} ELSE c.{c} END AS {c}" for c in cols)
    inside = " AND ".join(f"coalesce({m[k]} <= {k}_hi, true) AND coalesce({m[k]} >= {k}_lo, true)" for k in METRICS)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ws),
win AS (SELECT doc_id, i, CASE WHEN lead(x, 4) OVER o IS NOT NULL THEN x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o END AS g
  FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS r FROM win),
cov AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM dup),
rep AS (SELECT doc_id, sum(c) AS n FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
n AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN ws USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, {BASE_FAILED} AS base_failed FROM n),
lg AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {m[k]} AS v FROM b WHERE NOT base_failed" for k in METRICS)}),
sk AS (SELECT lang, source, metric, {bk} AS bucket, count(*) AS n FROM lg GROUP BY ALL),{level("own", "lang, source")},{level("lng", "lang")},{level("al", "")},
ch AS (SELECT a.lang AS fl, a.source AS fs, {pick} FROM own a LEFT JOIN lng b ON a.lang IS NOT DISTINCT FROM b.lang CROSS JOIN al c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM b LEFT JOIN ch ON lang IS NOT DISTINCT FROM fl AND source IS NOT DISTINCT FROM fs
"""


ORACLE_SQL = _oracle()
