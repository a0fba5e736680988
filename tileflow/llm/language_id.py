"""Language identification by rank-order n-gram profiles.

A text is reduced to its letters in lower case, words padded with a blank, and to its
``TOP`` most frequent n-grams of one to three characters. A language's profile is the same
list over its training texts. The distance of a text to a language is the sum, over the
text's n-grams, of how far out of place each is in the language's ranking; an n-gram the
profile lacks costs the full length. N-grams of equal count share their mean rank, so ties
do not favour a language.

Profiles are learned from at most about ``train_rows`` documents of each language, chosen by a
hash of the id (``train_rows`` is the documented bound of the fit); every text is predicted
whole. Counts are added up before they are shuffled; the driver receives ``TOP`` n-grams for
each language.

Defined results
    null text, or one without a letter: ``und`` with score 0. No labelled training row: ``und``
    and score 0 for all. Null language: never learned from. Equal distances: the language that
    sorts first. Repeated rows: each is predicted. Empty table: an empty result.
    score: second distance / (best + second), 0.5 (a tie) to 1; 1 where there is one language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileflow.llm.arrow import computed

TOP = 400
WIDTH = 21  # bits of a code point; three fit into a long


@cache
def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else 0."""
    return np.fromiter((c if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(0x110000)), np.uint32, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of one to three characters; a code packs code points, blank is 0."""
    cp = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not cp.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.concatenate([[0], cp, [0]])
    cp = cp[(cp != 0) | np.concatenate([[True], cp[:-1] != 0])]  # one blank between words
    alphabet = np.flatnonzero(np.bincount(cp)) if cp.max() < 0x3000 else np.unique(cp)
    n = len(alphabet)
    if cp.max() < 0x3000:
        table = np.zeros(alphabet[-1] + 1, np.int64)
        table[alphabet] = np.arange(n)
        a = table[cp]
    else:
        a = np.searchsorted(alphabet, cp)
    two = a[:-1] * n + a[1:]
    three = (two[:-1] * n + a[2:])[cp[1:-1] != 0]
    codes, counts = [], []
    letters = alphabet.astype(np.int64)
    for size, grams in ((1, a[cp != 0]), (2, two), (3, three)):
        if n**size <= 4 * len(grams) + 1024:
            c = np.bincount(grams)
            g = np.flatnonzero(c)
            c = c[g]
        else:
            g, c = np.unique(grams, return_counts=True)
        value = np.zeros(len(g), np.int64)
        for k in range(size):
            value = (value << WIDTH) | letters[g // n ** (size - 1 - k) % n]
        # a trigram fills 63 bits and code points stay below 2**21 - 2**16, so bit 62 and the size mark shorter ones
        codes.append(value if size == 3 else value | (size << (2 * WIDTH)) | (0x1F << 58))
        counts.append(c)
    return np.concatenate(codes), np.concatenate(counts)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` most frequent n-grams with their ranks; equal counts share their mean rank."""
    order = np.lexsort((codes, -counts))[:top]
    c = counts[order]
    first = np.searchsorted(-c, -c, "left")
    last = np.searchsorted(-c, -c, "right")
    return codes[order], (first + last - 1) / 2


class Profiles:
    """Rankings of all languages, looked up together."""

    def __init__(self, rankings: dict[str, tuple[np.ndarray, np.ndarray]], top: int = TOP):
        self.langs, self.top = sorted(rankings), top
        self.codes = np.unique(np.concatenate([rankings[k][0] for k in self.langs])) if rankings else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes)), np.nan)
        for i, k in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, rankings[k][0])] = rankings[k][1]

    def distances(self, codes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        off = np.abs(self.ranks[:, at[known]] - ranks[known])
        return np.where(np.isnan(off), self.top, off).sum(axis=1) + self.top * (~known).sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        d = self.distances(*ranked(codes, counts, self.top))
        best = int(np.argmin(d))
        if len(d) == 1:
            return self.langs[0], 1.0
        second = np.partition(d, 1)[1]
        return self.langs[best], float(second / (d[best] + second)) if second > 0 else 0.5


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 5000, top: int = TOP) -> Profiles:
    """docs: the training documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Profiles({}, top)
    share = F.lit(0.0)
    for lang, n in size.items():
        share = F.when(F.col("lang") == lang, min(1.0, train_rows / n)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                codes, counts = ngrams("\n".join(texts))
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    total = chosen.select("lang", "text").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= top).toPandas()
    return Profiles({lang: ranked(g["code"].to_numpy(), g["n"].to_numpy(), top) for lang, g in first.groupby("lang")}, top)


def predicted(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every document; only the text is read."""

    def make():
        def each(texts: list) -> list:
            found = [profiles.predict(t) for t in texts]
            return [[x[0] for x in found], [x[1] for x in found]]

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return computed(rows, ["text"], make, "lang_pred string, score double").withColumnRenamed("id", id_col)


def language_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 5000) -> DataFrame:
    """Learns from documents outside the held-out fold, predicts all."""
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    profiles = learn(docs.where(~held), id_col=id_col, text_col=text_col, lang_col=lang_col, train_rows=train_rows)
    out = predicted(docs, profiles, id_col=id_col, text_col=text_col)
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")
