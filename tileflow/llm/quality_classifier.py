"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text is reduced to the statistics of ``FEATURES``, transformed towards normality
(log of counts, square root of shares). Each class gets a mean and a covariance shrunk
towards the pooled one and then towards its diagonal; Cholesky factors are computed once
and cached in the model. A score is the logistic of the difference of the two Gaussian
log densities (Mahalanobis distance and log determinant) plus the log prior ratio.

Fitting adds up moments over all labelled training rows: each task emits one set of sums,
sums are added before they meet, and the driver receives two classes' moments, whatever
the number of rows.

Defined results
    null or empty text: the statistics of the empty text, and their score. Null or repeated
    labels: nulls are ignored, a document with several labels counts once with the largest.
    Null id: never labelled, scored like any other. No training row of a class: every score is
    0.5. Repeated rows: each is scored. Empty table: an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.arrow import computed, kept
from tileflow.llm.scratch import stage

FEATURES = ("log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "symbols", "punctuation", "exclamations", "bars", "distinct", "repeats", "commonest", "dup_lines", "words_per_stop", "capital_words")
#: Shrinkage of a class covariance towards the pooled one, then towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.15, 0.05
RIDGE = 1e-3
CUT = 0.7

LETTER, UPPER, DIGIT, SPACE, SYMBOL, PUNCT = 1, 2, 4, 8, 16, 32


@cache
def _classes() -> np.ndarray:
    """Bits of each code point of the basic plane; all others count as letters."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        ch, cat = chr(c), unicodedata.category(chr(c))
        out[c] = (LETTER if cat[0] == "L" else 0) | (UPPER if cat == "Lu" else 0) | (DIGIT if cat[0] == "N" else 0) | (SPACE if ch in " \t\n\x0b\x0c\r" else 0) | (SYMBOL if ch in "#*$%&|<>" or cat[0] == "S" else 0) | (PUNCT if cat[0] == "P" else 0)
    return out


def statistics(text: str | None) -> np.ndarray:
    """One value for each of FEATURES."""
    text = text or ""
    words = text.translate(_BREAKS).split(" ") if text else []
    words = [w for w in words if w]
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = np.where(cp < 0x10000, _classes()[np.minimum(cp, 0xFFFF)], LETTER)
    chars = len(cp)
    counts = np.bincount(bits, minlength=64)
    of = lambda bit: int(counts[(np.arange(len(counts)) & bit) > 0].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    solid = max(chars - of(SPACE), 1)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    stops = sum(text.count(c) for c in ".!?")
    root = lambda x: float(np.sqrt(max(x, 0.0)))
    return np.array([
        np.log1p(n), np.log(lengths.mean()), np.log1p(lengths.std()), root(of(LETTER) / solid), root(of(UPPER) / solid), root(of(DIGIT) / solid), root(of(SYMBOL) / solid), root(of(PUNCT) / solid),
        root(text.count("!") / n), root(text.count("|") / n), root(len(seen) / n), root(sum(map(str.__eq__, words, words[1:])) / n), root(max(seen.values()) / n),
        root(1 - len(set(lines)) / len(lines)), np.log1p(n / (1 + stops)), root(sum(map(str.isupper, words)) / n),
    ])


_BREAKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


@dataclass(frozen=True)
class Model:
    """Means, whitening factors (inverse Cholesky), half log determinants and log prior ratio."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    prior: float

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        d = [(((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 0.5 * (d[0] - d[1]) + self.log_det[0] - self.log_det[1] + self.prior


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model | None:
    """moments: class -> (rows, sum of x, sum of x x'). None if a class has no row."""
    if any(c not in moments or moments[c][0] < 1 for c in (0, 1)):
        return None
    n = np.array([moments[c][0] for c in (0, 1)])
    mean = np.array([moments[c][1] / n[c] for c in (0, 1)])
    cov = np.array([moments[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    whiten, log_det = [], []
    for c in (0, 1):
        s = (1 - TO_POOLED) * cov[c] + TO_POOLED * pooled
        s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(len(s))
        chol = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(chol))
        log_det.append(np.log(np.diag(chol)).sum())
    return Model(mean, np.array(whiten), np.array(log_det), float(np.log(n[1] / n[0])))


def scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return np.round(1 / (1 + np.exp(-np.clip(model.log_ratio(x), -700, 700))), 9)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x: statistics) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return computed(rows, ["text"], lambda: lambda texts: [[statistics(t) for t in texts]], "x array<double>")


def train(rows: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", label_col: str = "quality", held_out: str = "pmod(crc32(CAST(CAST(id AS STRING) AS BINARY)), 4) = 2") -> Model | None:
    """rows(id, x), staged; labels of rows for which ``held_out`` holds are never read."""
    y = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where(f"id IS NOT NULL AND y IN (0, 1) AND NOT ({held_out})").groupBy("id").agg(F.max("y").alias("y"))
    size = len(FEATURES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {c: np.zeros((size + 1, size + 1)) for c in (0, 1)}
        for b in batches:
            for c in (0, 1):
                if (at := b["y"].to_numpy() == c).any():
                    x = np.column_stack([np.ones(at.sum()), np.stack(b["x"][at].to_numpy())])
                    total[c] += x.T @ x
        for c in (0, 1):
            yield pd.DataFrame({"y": c, "i": np.arange((size + 1) ** 2), "v": total[c].ravel()})

    parts = rows.join(y, "id").select("y", "x").mapInPandas(sums, "y int, i int, v double")
    moments = {c: np.zeros((size + 1, size + 1)) for c in (0, 1)}
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        moments[r.y].flat[r.i] = r.v
    return fit({c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in moments.items() if m[0, 0] >= 1})


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    rows = stage(measured(docs, id_col, text_col), "quality-statistics")
    model = train(rows, labels)

    def make():
        def each(x: list) -> list:
            s = scores(model, np.array(x))
            return [s, (s >= cut).astype(np.int32)]

        return each

    out = computed(rows, ["x"], make, "score double, predicted int")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents whose score reaches ``cut``, with all their columns. They are staged with their statistics, which
    costs less than to compute these again."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stage(computed(rows, ["text"], lambda: lambda texts: [[statistics(t) for t in texts]], "x array<double>"), "quality-documents")
    model = train(rows.select("id", "x"), labels)
    return kept(rows.select("doc", "x"), "x", lambda: lambda x: scores(model, np.array(x)) >= cut).select("doc.*")
