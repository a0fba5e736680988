"""Near-duplicate documents by Order MinHash.

Texts are sequences of words; k-mers are ``K`` = 5 words, labelled by occurrence so that the
n-th copy of a k-mer in a text is an element of its own. Each of ``SKETCHES`` hash functions
picks the ``PICK`` labelled k-mers of smallest hash and keeps them in text order; two texts
share a sketch only if they share these k-mers in the same order, which follows edit
similarity rather than set overlap. A text that repeats k-mers is also sketched over its
different k-mers, in order of first occurrence and, for pairs in which both texts repeat,
without order, as different k-mers count however often each occurs. Texts that differ in one word of twenty share a sketch with probability of about 0.4, in one of ten of about
0.17; so of pairs that meet at random places, 1 in 4,000 and 1 in 20 share none of 16.

Candidates are verified by banded alignment, twice. Of k-mers: labelled k-mers common to both texts are the matching cells, cells
further from the diagonal than the threshold allows are outside the band, and the longest chain that rises in both
texts is the alignment; similarity is the number of different k-mers aligned over the different k-mers of either
text. Of words: the longest common subsequence within such a band, by bit vectors; similarity is the number of words aligned over the
words of the longer text. (In texts of more than ``EXACT`` words, words between aligned k-mers are aligned so, and runs of more than ``EXACT``
between them by labelled words.) A pair is near if either is 0.8 or more: by words a few single changes in a text
count once each and not for each k-mer, by different k-mers a passage repeated more often changes nothing.

Equal texts are one node from the start, so copies are never paired. Texts that share a
sketch are first compared with one of them (its leader); links found so merge into
classes; then texts of one sketch that are still in different classes are compared with
each other in blocks of bounded size, so no link is lost. A task returns only links that join
classes; pairs are never rows. Hot sketches are split over tasks, not gathered.

Defined results
    null text: a class of its own (rows repeated with their id: one class). Texts without a word: only
    equal texts are one class. Texts of fewer than five words: one k-mer of all words. Texts of so few words that changes leave no
    k-mer as it was share no sketch, whatever their similarity. Repeated
    rows: one class. Null id: takes part by its text; a class whose ids are all null has a null id.
    Ties: the smallest id of a class represents it, and of rows with that id, one is kept. Empty table:
    an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.llm.arrow import computed
from tileflow.llm.components import components
from tileflow.llm.groups import grouped
from tileflow.llm.scratch import stage

K = 5
SKETCHES, PICK = 16, 2
THRESHOLD = 0.8
#: Words of a text that are aligned at once.
EXACT = 4096
EPS = 1e-9

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SEEDS = np.array([xxhash.xxh64_intdigest(b"sketch %d" % j) for j in range(SKETCHES)], np.uint64)
#: A sketch's hash function: k-mers are hashes already, so an odd factor of its own gives it an order of its own.
FACTORS = np.array([xxhash.xxh64_intdigest(b"factor %d" % j) | 1 for j in range(SKETCHES)], np.uint64)


#: Base of the polynomial that hashes the bytes of a word modulo 2^64, and its inverse.
BASE = 0x2545F4914F6CDD1D
#: Bytes whose words are hashed together, and the longest word hashed so; a longer one is hashed by xxh3.
SPAN, LONG_WORD = 1 << 20, 1 << 16


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for all i below 2^bits."""
    out = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        for k in range(bits):
            p = np.concatenate([p, p * np.uint64(pow(x, 1 << k, 1 << 64))])
        out.append(p)
    return out[0], out[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order: words are hashed by their bytes, all of a stretch at once."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + SPAN, "right")), at + 1)
        first, last = starts[at], ends[to - 1]
        if last - first <= SPAN:
            up, down = _powers(max(int(last - first).bit_length(), 10))
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum((raw[first:last].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    out ^= out >> np.uint64(32)
    out *= MIX2
    return out ^ (out >> np.uint64(29))


def kmers(text: str | None) -> np.ndarray:
    """Hashes of the K-word k-mers in text order; a shorter text is one k-mer; no word, none."""
    return shingles(word_hashes(text or ""))


def shingles(h: np.ndarray) -> np.ndarray:
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(K, n)
    out = h[: n - width + 1].copy()
    for i in range(1, width):
        out *= MULT
        out += h[i : n - width + 1 + i]
    out ^= out >> np.uint64(29)
    out *= MIX1
    return out ^ (out >> np.uint64(32))


def labelled(s: np.ndarray) -> np.ndarray:
    """The n-th occurrence of a k-mer gets a hash of its own; first occurrences keep theirs."""
    order = np.argsort(s, kind="stable")
    same = s[order[1:]] == s[order[:-1]]
    if not same.any():
        return s
    start = np.concatenate([[True], ~same])
    index = np.arange(len(s))
    nth = index - np.maximum.accumulate(np.where(start, index, 0))
    out = s.copy()
    out[order] += nth.astype(np.uint64) * MULT
    return out


def _smallest(x: np.ndarray) -> np.ndarray:
    """For each sketch, the positions in x of the PICK smallest under its hash function, ascending."""
    n = len(x)
    if n <= PICK:
        return np.tile(np.arange(n), (SKETCHES, 1))
    v = x[None, :] * FACTORS[:, None]
    if n >= 64:  # of a uniform hash, about 16 of a row lie below this bound
        row, at = np.nonzero(v < np.uint64((16 << 64) // n))
        count = np.bincount(row, minlength=SKETCHES)
        if count.min() >= PICK:
            first = np.cumsum(count) - count
            at = at[np.lexsort((v[row, at], row))][first[:, None] + np.arange(PICK)]
            at.sort(axis=1)
            return at
    at = np.argpartition(v, PICK - 1, axis=1)[:, :PICK]
    at.sort(axis=1)
    return at


def _keys(chosen: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    key = SEEDS ^ salt
    for c in range(chosen.shape[1]):
        key ^= chosen[:, c]
        key *= MIX2
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def sketches(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys over the labelled k-mers, and those over the different k-mers of a text that repeats some.

    A text without repeats has the same different as labelled k-mers. It aligns first occurrences only, so the order of
    these holds for pairs with it; where both texts repeat, later occurrences may be aligned, so order is left out too.
    """
    x = labelled(s)
    keys = _keys(x[_smallest(x)])
    if x is s:
        return keys, np.zeros(0, np.int64)
    first = s[x == s]
    chosen = first[_smallest(first)]
    return keys, np.concatenate([_keys(chosen), _keys(np.sort(chosen, axis=1), MULT)])


def similarity(a: np.ndarray, b: np.ndarray, least: float = THRESHOLD) -> float:
    """The larger of both measures of two texts, given as hashes of their words; 0 where neither can reach ``least``."""
    found = kmer_similarity(shingles(a), shingles(b), least)
    return found if found >= least - EPS else max(found, word_similarity(a, b, least))


def kmer_similarity(a: np.ndarray, b: np.ndarray, least: float = THRESHOLD) -> float:
    """Aligned different k-mers over all different k-mers of texts with k-mers a and b; 0 where the sizes or the common k-mers alone
    rule out ``least``."""
    n, m = len(np.unique(a)), len(np.unique(b))
    if not n or not m or min(n, m) < least * max(n, m) - EPS:
        return 0.0
    need = least / (1 + least) * (n + m) - EPS
    # an alignment good enough leaves at most this many k-mers of either text unmatched
    i, _ = _chain(a, b, max(len(a), len(b)) - int(need), need)
    aligned = len(np.unique(a[i]))
    return aligned / (n + m - aligned)


def word_similarity(a: np.ndarray, b: np.ndarray, least: float = THRESHOLD) -> float:
    """Aligned words over the words of the longer text; 0 where the lengths or the common words alone rule out ``least``."""
    n = max(len(a), len(b))
    need = least * n - EPS
    if not n or min(len(a), len(b)) < need or len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:
        return 0.0
    return _aligned(a, b, n - int(need)) / n


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words aligned, none further than ``band`` from the diagonal."""
    if max(len(a), len(b)) <= EXACT:
        return common_words(a.tolist(), b.tolist(), band)
    i, j = _chain(shingles(a), shingles(b), band)
    edges = [(0, 0)]
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if x >= edges[-1][0] and y >= edges[-1][1]:
            edges += [(x, y), (x + K, y + K)]
    edges.append((len(a), len(b)))
    total = K * (len(edges) // 2 - 1)
    for (x0, y0), (x1, y1) in zip(edges[::2], edges[1::2], strict=True):
        left, right = a[x0:x1], b[y0:y1]
        if max(len(left), len(right)) <= EXACT:
            total += common_words(left.tolist(), right.tolist(), band)
        else:
            total += len(_chain(left, right, band)[0])
    return total


def common_words(a: list[int], b: list[int], band: int) -> int:
    """Length of a longest common subsequence of cells (i, j) with abs(i - j) <= band. Bit j of ``rows`` is 0 where the row so far gains a
    word at b[j]; an addition carries each gain to its place."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    at: dict[int, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    inside, rows = (1 << 2 * band + 1) - 1, full
    for i, w in enumerate(a):
        if found := at.get(w):
            gains = rows & found & (inside << i - band if i > band else inside >> band - i)
            rows = (rows + gains | rows - gains) & full
    return head + tail + len(b) - rows.bit_count()


def _chain(a: np.ndarray, b: np.ndarray, band: int, need: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """A longest chain of equal labelled elements that rises in both, within the band; none where fewer than ``need`` are equal."""
    common, i, j = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    if len(common) < need:
        return i[:0], j[:0]
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j) and (np.diff(j) <= 0).any():
        chain = _rising(j)
        i, j = i[chain], j[chain]
    return i, j


def _rising(j: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly rising subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = np.full(len(j), -1)
    for at, x in enumerate(j.tolist()):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            ends.append(at)
        else:
            tails[k], ends[k] = x, at
        back[at] = ends[k - 1] if k else -1
    out, at = [], ends[-1]
    while at >= 0:
        out.append(at)
        at = back[at]
    return np.array(out[::-1])


def fingerprint(id_col: str, text_col: str) -> Column:
    """16 bytes that are equal for equal texts; a null text has those of its id, and without one those of nothing."""
    return F.unhex(F.md5(F.when(F.col(text_col).isNotNull(), F.concat(F.lit("t"), F.col(text_col))).otherwise(F.coalesce(F.concat(F.lit("n"), F.col(id_col).cast("string")), F.lit("")))))


def is_nothing(fp: str) -> Column:
    """Rows without text and id: nothing tells them apart, but each is a class of its own."""
    return F.col(fp) == F.unhex(F.md5(F.lit("")))


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, row: a number of its own, n: k-mers, keys) of every row; keys is empty for a text without words. To be
    staged before ``row`` is used, which another run of a task may give otherwise."""

    def make():
        def each(texts: list) -> list:
            found = [kmers(t) for t in texts]
            return [[len(s) for s in found], [np.unique(np.concatenate(sketches(s))) if len(s) else np.zeros(0, np.int64) for s in found]]

        return each

    rows = docs.select(F.col(id_col).alias("id"), fingerprint(id_col, text_col).alias("fp"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return computed(rows, ["text"], make, "n long, keys array<long>")


def texts_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted(f, rep: an id of that text) -> staged (fp, text), one row for each text. Rows meet by text and id, so
    that copies of one text do not meet in one task."""
    texts = docs.where(F.col(text_col).isNotNull()).select(fingerprint(id_col, text_col).alias("fp"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    same = (F.col("fp") == F.col("f")) & F.col("id").eqNullSafe(F.col("rep"))
    return stage(texts.join(wanted, same, "left_semi").groupBy("fp").agg(F.first("text").alias("text")), "near-texts")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) of fingerprints -> those whose texts are similar."""
    a, b = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, s = None, np.zeros(0, np.uint64)
        for x in batches:
            keep = []
            for fp, ta, tb in zip(x["a"], x["text_a"], x["text_b"], strict=True):
                if fp != last:
                    last, s = fp, word_hashes(ta)
                keep.append(similarity(s, word_hashes(tb), least) >= least - EPS)
            yield x.loc[keep, ["a", "b"]]

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a binary, b binary")


#: Texts of a block, and about how many words; a sketch with more is compared block by block, each pair of blocks a group of its own.
BLOCK, BLOCK_WORDS = 1024, 1_000_000
#: Words whose presence is held as a dense table at a time.
COLUMNS = 4096
#: Words of a group that are sorted at a time.
SORTED = 4_000_000


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of elements that each of the ascending sets of left shares with each of right, all at once."""
    sets, out = [*left, *right], np.zeros((len(left), len(right)), np.float32)
    parts = -(-sum(map(len, sets)) // SORTED)
    ends = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    edges = np.array([[0, *np.searchsorted(x, ends), len(x)] for x in sets])
    for p in range(parts):
        cut = [x[a:b] for x, a, b in zip(sets, edges[:, p], edges[:, p + 1], strict=True)]
        row = np.repeat(np.arange(len(sets)), [len(x) for x in cut])
        _, column = np.unique(np.concatenate(cut), return_inverse=True)
        n = int(column.max()) + 1 if len(column) else 0
        on_left = row < len(left)
        both = (np.bincount(column[on_left], minlength=n) > 0) & (np.bincount(column[~on_left], minlength=n) > 0)
        common = both[column]
        row, column = row[common], (np.cumsum(both) - 1)[column[common]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(both.sum()), COLUMNS):
            at = slice(*np.searchsorted(column, [start, start + COLUMNS]))
            table = np.zeros((len(sets), min(COLUMNS, int(both.sum()) - start)), np.float32)
            table[row[at], column[at] - start] = 1
            out += table[: len(left)] @ table[len(left) :].T
    return out


def linking_pairs(g: pd.DataFrame, least: float) -> list[tuple[bytes, bytes]]:
    """One group (key, i, j): links that join the classes of its texts, as few as do that.

    Pairs of different classes go through two gates: shared k-mers and shared labelled words (exact, all pairs at once; no
    alignment can exceed both), alignment. A pair already joined through others is not aligned.
    """
    fp, own = g["fp"].to_numpy(), g["own"].to_numpy()
    comp = pd.factorize(g["component"])[0]
    left, right = np.flatnonzero(own == g["i"].iat[0]), np.flatnonzero(own == g["j"].iat[0])
    if not len(left) or not len(right) or comp.max() == 0:
        return []
    s = [word_hashes(t) for t in g["text"]]
    share = np.zeros((len(left), len(right)))
    for sets, jaccard in (([np.unique(shingles(x)) for x in s], True), ([np.sort(labelled(x)) for x in s], False)):
        n = np.array([len(x) for x in sets])
        both = shared_counts([sets[x] for x in left], [sets[x] for x in right])
        of = n[left][:, None] + n[right][None, :] - both if jaccard else np.maximum(n[left][:, None], n[right][None, :])
        share = np.maximum(share, both / of)
    a, b = np.nonzero((share >= least - EPS) & (comp[left][:, None] != comp[right][None, :]))
    share, a, b = share[a, b], left[a], right[b]
    once = (g["i"].iat[0] < g["j"].iat[0]) | (a < b)
    share, a, b = share[once], a[once], b[once]
    order = np.argsort(-share, kind="stable")
    parent = list(range(comp.max() + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        cx, cy = root(comp[x]), root(comp[y])
        if cx != cy and similarity(s[x], s[y], least) >= least - EPS:
            parent[cx] = cy
            out.append((fp[x], fp[y]))
    return out


def remaining_links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """members(key, fp, n: k-mers, component), staged -> links (a, b) between different classes of a key.

    A key's largest class is never compared within itself: its texts are in blocks of their own, which meet only the
    blocks of the other texts. So a key costs its size times the texts outside its largest class.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n").alias("words"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "words")).alias("most"), F.sum("n").alias("m"), F.sum("words").alias("all")).where("most.n < m")
    blocks = lambda n, words: F.greatest(F.ceil(n / BLOCK), F.ceil(words / BLOCK_WORDS)).cast("int")
    mains, others = blocks(F.col("most.n"), F.col("most.words")), blocks(F.col("m") - F.col("most.n"), F.col("all") - F.col("most.words"))
    keys = keys.select(F.col("key").alias("k"), F.col("most.component").alias("main"), mains.alias("mains"), others.alias("others"))
    rows = members.join(stage(keys, "near-unsettled"), F.col("key") == F.col("k")).withColumn("within", F.col("component") == F.col("main"))
    own = F.when(F.col("within"), F.col("others") + F.pmod(F.xxhash64("fp"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("fp"), F.col("others")))
    met = F.when(F.col("within"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "component").join(texts, "fp")
    by = ["key", "i", "j"]

    def each(g: pd.DataFrame) -> pd.DataFrame | None:
        found = linking_pairs(g, least)
        return pd.DataFrame(found, columns=["a", "b"]) if found else None

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by).sortWithinPartitions(*by).mapInPandas(grouped(by, each, ["a", "b"]), "a binary, b binary")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows(id, fp, row) of all documents, classes(fp, component) of the texts that have a near-duplicate text)."""
    rows = stage(sketched(docs, id_col, text_col), "near-sketches")
    texts = stage(rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "near-nodes")
    member = texts.select("fp", "n", F.explode("keys").alias("key"))
    shared = stage(member.groupBy("key").agg(F.count("*").alias("m"), F.min("fp").alias("leader")).where("m > 1"), "near-shared")
    member = stage(member.join(shared, "key"), "near-members")
    tested = stage(member.where("fp <> leader").select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct(), "near-pairs")
    wanted = texts.join(member.select("fp").distinct(), "fp", "left_semi").select(F.col("fp").alias("f"), "rep")
    full = texts_of(wanted, docs, id_col, text_col)
    links = stage(verified(tested, full, least), "near-links")
    found = components(links)
    # a key of two texts is settled by its one pair; larger ones may still join different classes
    larger = member.where("m > 2").join(found, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", F.coalesce("component", "fp").alias("component"))
    more = stage(remaining_links(stage(larger, "near-larger"), full, least), "near-links")
    if not more.isEmpty():
        found = components(links.union(more))
    return rows.select("id", "fp", "row"), found.withColumnRenamed("node", "fp")


def labelled_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, fp, row, component) of every row; a text without near-duplicates is its own component."""
    found = found.select(F.col("fp").alias("node"), "component")
    return rows.join(found, rows.fp == found.node, "left").select("id", "fp", "row", F.coalesce("component", "fp").alias("component"))


def first_rows(rows: DataFrame) -> DataFrame:
    """component -> (class_id, first: the one row that represents it, id, fp of that row)."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "fp"))
    # staged: a join with the output of an aggregation can't be split where one class is very large
    return stage(rows.groupBy("component").agg(first.alias("k")).select("component", F.col("k.id").alias("class_id"), F.col("k.row").alias("first"), F.col("k.fp").alias("first_fp")), "near-first")


def near_duplicate_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """(id, class_id: smallest id of the class, kept: one row of each class) for every document."""
    rows = stage(labelled_rows(*classes(docs, id_col=id_col, text_col=text_col, least=least)), "near-classes")
    out = rows.join(first_rows(rows), "component")
    return out.select(F.col("id").alias(id_col), "class_id", ((F.col("row") == F.col("first")) | is_nothing("fp")).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """One document of each class, with its columns: the one of smallest id, a text of which the class has."""
    rows = stage(labelled_rows(*classes(docs, id_col=id_col, text_col=text_col, least=least)), "near-classes")
    keep = first_rows(rows).select(F.col("class_id").alias("keep_id"), F.col("first_fp").alias("keep_fp"))
    packed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("row_id"), fingerprint(id_col, text_col).alias("row_fp"))
    same = packed.row_fp.eqNullSafe(F.col("keep_fp")) & packed.row_id.eqNullSafe(F.col("keep_id"))
    kept = packed.join(keep, same, "left_semi")
    twice = rows.where(~is_nothing("fp")).groupBy("id", "fp").count().where("count > 1").select(F.col("id").alias("twice_id"), F.col("fp").alias("twice_fp"))
    twin = packed.row_fp.eqNullSafe(F.col("twice_fp")) & packed.row_id.eqNullSafe(F.col("twice_id"))
    # rows repeated as they are: only those are compared row by row
    once = kept.join(twice, twin, "left_anti")
    again = kept.join(twice, twin, "left_semi").dropDuplicates(["row_fp", "row_id"])
    return once.union(again).select("doc.*")
