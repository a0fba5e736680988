"""Small tables with everything that may go wrong in one column or another."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

BIG = (1 << 62) + 12345  # not a floating-point number
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
NAMES = ["id", "size", "hk", "fp", "bin", "done", "shard", "score", "keys", "component"]  # extra columns with names used inside


def documents(spark, rows=None, extra=True):
    rows = ROWS if rows is None else rows
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
    df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], schema)
    return df.selectExpr("*", *[f"'x' AS `{n}`" for n in NAMES]) if extra else df


def text(seed, n=60):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


ROWS = [
    (1, text(1), "en", "a"), (2, text(1), "en", "a"), (BIG, text(2), "de", "b"), (4, None, "en", "a"), (5, "", "en", None), (6, "  \t\n ", None, "b"), (7, "one", None, None), (8, LONG, "en", "a"),
    (None, text(3), "fr", "c"), (None, None, None, None), (11, text(4) + ' token = "abcdefghij0123456789"', "en", "a"), (11, text(4) + ' token = "abcdefghij0123456789"', "en", "a"), (12, "\U0001f600 \U0001f600\n\U0001f600", "en", "c"),
]
