import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import ROWS, documents, text
from tileflow.llm import near_duplicates as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(t, edits, seed):
    r, w = random.Random(seed), t.split()
    for _ in range(edits):
        i = r.randrange(len(w))
        r.choice([lambda: w.__setitem__(i, "zz%d" % r.randrange(999)), lambda: w.insert(i, "yy%d" % r.randrange(999)), lambda: w.pop(i)])()
    return " ".join(w)


def common(a, b):
    """Longest common subsequence by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = last + 1 if x == y else max(row[j], row[j - 1]), row[j]
    return row[-1]


def near(t, u, least):
    """Near by different 5-word shingles or by words in order."""
    a, b = shingles(t), shingles(u)
    if not a or not b:
        return False
    if len(a & b) >= least * len(a | b) - 1e-9:
        return True
    x, y = WORD.findall(t), WORD.findall(u)
    need = least * max(len(x), len(y)) - 1e-9
    return (Counter(x) & Counter(y)).total() >= need and common(x, y) >= need


def brute(docs, least=0.8):
    texts = sorted({t for _, t, *_ in docs if t is not None})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and near(texts[i], texts[j], least):
                parent[root(i)] = root(j)
    of = {t: root(i) for i, t in enumerate(texts)}
    groups = defaultdict(set)
    for i, t, *_ in docs:
        groups[("n", i) if t is None else of[t]].add(i)
    return sorted(sorted(g, key=str) for g in groups.values())


def classes(rows):
    groups = defaultdict(set)
    for r in rows:
        groups[r.class_id].add(r.doc_id)
    return sorted(sorted(g, key=str) for g in groups.values())


def test_against_brute_force(spark):
    docs, i = [], 0
    for base in range(60):
        t = text(base, 60 + base * 3)
        for copy in range(1 + base % 5):
            docs.append((i, edited(t, copy * (1 + base % 3), base * 10 + copy), "en", "a"))
            i += 1
    docs += [(1000 + k, docs[k][1], "en", "b") for k in range(0, 40, 7)]
    rows = N.near_duplicate_report(documents(spark, docs)).collect()
    assert len(rows) == len(docs)
    assert classes(rows) == brute(docs)
    assert all(r.kept == (r.doc_id == r.class_id) and r.class_id <= r.doc_id for r in rows)


def test_crowded_sketches(spark):
    """A group whose links straddle the threshold, and texts that share one long passage."""
    t = text(7, 146)
    docs = [(i, edited(t, i % 9, i), "en", "a") for i in range(150)]
    passage = text(8, 60)
    docs += [(200 + i, f"{text(300 + i, 14)} {passage} {text(400 + i, 14)}", "en", "a") for i in range(60)]
    assert classes(N.near_duplicate_report(documents(spark, docs)).collect()) == brute(docs)


def test_repeated_passages(spark):
    """Repeats of a passage change what is shared of words and labelled k-mers, not of different ones."""
    docs = []
    for base in range(40):
        w = text(base, 104).split()
        at = base * 2
        docs += [(10 * base + n, " ".join(w + w[at : at + 24] * times), "en", "a") for n, times in enumerate((0, 10, 30))]
    want = brute(docs)
    assert len(want) == 40
    assert classes(N.near_duplicate_report(documents(spark, docs)).collect()) == want


def test_pairs_of_a_group_are_not_gated_by_picks():
    import pandas as pd

    w = text(5, 104).split()
    texts = [" ".join(w + w[20:44] * times) for times in (0, 10, 30)]
    g = pd.DataFrame({"key": 1, "i": 0, "j": 0, "own": 0, "fp": [b"a", b"b", b"c"], "component": [b"a", b"b", b"c"], "text": texts})
    assert len(N.linking_pairs(g, 0.8)) == 2


@pytest.mark.parametrize("limit", [7, 100, 10**6])
def test_shared_counts(monkeypatch, limit):
    monkeypatch.setattr(N, "SORTED", limit)
    monkeypatch.setattr(N, "COLUMNS", 8)
    r = np.random.default_rng(limit)
    common = r.integers(0, 1 << 64, 40, np.uint64)
    left, right = ([np.unique(r.choice(common, r.integers(1, 30))) for _ in range(n)] for n in (9, 5))
    assert N.shared_counts(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    t = text(7, 146)
    docs = [(i, edited(t, i % 9, i), "en", "a") for i in range(100)]
    assert classes(N.near_duplicate_report(documents(spark, docs)).collect()) == brute(docs)


def test_odd_rows(spark):
    rows = N.near_duplicate_report(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.class_id, r.kept))
    assert by[1] == {(1, True)}
    assert by[2] == {(1, False)}
    assert by[11] == {(11, True), (11, False)}, "of repeated rows one is kept"
    assert sum(r.kept for r in rows) == N.deduplicated(documents(spark)).count()
    assert by[4] == {(4, True)}
    assert by[5] == {(5, True)}
    assert N.near_duplicate_report(documents(spark, [])).count() == 0


def test_rows_without_text_and_id_are_all_kept(spark):
    docs = documents(spark, [(None, None, "en", "a")] * 3 + [(4, None, "en", "a")] * 2 + [(None, "same words in here now", "en", "a")] * 2)
    rows = N.near_duplicate_report(docs).collect()
    assert sorted((str(r.class_id), r.kept) for r in rows) == [("4", False), ("4", True)] + [("None", False)] + [("None", True)] * 4
    assert N.deduplicated(docs).count() == 5


def test_repeated_lines_by_brute_force(spark):
    """Texts made of a few lines, each repeated: all pairs are similar by their different k-mers alone."""
    docs, r = [], random.Random(3)
    for base in range(30):
        lines = [text(base * 10 + k, 24) for k in range(1 + base % 3)]
        for n in range(6):
            docs.append((100 * base + n, "\n".join(line for line in lines for _ in range(r.randint(2, 20))), "en", "a"))
    want = brute(docs)
    assert classes(N.near_duplicate_report(documents(spark, docs)).collect()) == want


def test_word_hashes():
    """Equal words, equal hashes, wherever they stand and however long the text."""
    r = random.Random(4)
    words = ["é", "a", "b", "ab", "ba", "\x00", "\x00\x00", "\x1c", "你好", "\ud800", "w" * 70_000, "w" * 70_001, *[text(i, 1) for i in range(500)]]
    t = "".join(r.choice(words) + r.choice([" ", "\n", "\t\x0b ", "  "]) for _ in range(3000))
    w, h = WORD.findall(t), N.word_hashes(t).tolist()
    assert len(w) == len(h)
    assert len(set(zip(w, h, strict=True))) == len(set(w)) == len(set(h))
    long = "".join(x + " " for x in words) * 400
    assert N.word_hashes(long).tolist() == N.word_hashes("".join(x + " " for x in words)).tolist() * 400


@pytest.mark.parametrize("n", [1, 2, 3, 4, 63, 64, 500])
def test_picked_kmers_by_sorting(n):
    x = np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64)
    for j, at in enumerate(N._smallest(x)):
        v = x * N.FACTORS[j]
        assert at.tolist() == sorted(np.argsort(v)[: N.PICK].tolist())


def test_deduplicated(spark):
    docs = documents(spark)
    out = N.deduplicated(docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids == Counter([1, ROWS[2][0], 4, 5, 6, 7, 8, None, None, 11, 12])


@pytest.mark.parametrize("seed", range(20))
def test_similarity_is_exact_without_moves(seed):
    r = random.Random(seed)
    t = " ".join(r.choice(["a", "b", "c", "dd", "e%d" % r.randrange(40)]) for _ in range(r.randint(1, 120)))
    u = edited(t, r.randrange(4), seed)
    a, b = shingles(t), shingles(u)
    exact = len(a & b) / len(a | b) if a | b else 0.0
    got = N.kmer_similarity(N.kmers(t), N.kmers(u), 0.0)
    assert got <= exact + 1e-9
    if exact >= 0.8 and len(set(t.split())) == len(t.split()):
        assert got == pytest.approx(exact)
    x, y = t.split(), u.split()
    assert N.word_similarity(N.word_hashes(t), N.word_hashes(u), 0.0) == pytest.approx(common(x, y) / max(len(x), len(y)))


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_are_aligned_in_parts(seed, monkeypatch):
    """Between aligned k-mers; at most a little below the whole alignment."""
    t = text(seed, 900)
    u = edited(t, 20 + 20 * seed, seed)
    a, b = N.word_hashes(t), N.word_hashes(u)
    whole = N.word_similarity(a, b, 0.5)
    for exact in (100, 3):
        monkeypatch.setattr(N, "EXACT", exact)
        assert whole - 0.02 <= N.word_similarity(a, b, 0.5) <= whole


@pytest.mark.parametrize("band", [0, 1, 3, 50])
def test_common_words_in_a_band(band):
    r = random.Random(band)
    for _ in range(60):
        a, b = ([r.randrange(6) for _ in range(r.randrange(30))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = max(row[i][j + 1], row[i + 1][j], row[i][j] + (x == y and abs(i - j) <= band))
        found = N.common_words(a, b, band)
        assert row[-1][-1] == found if band == 50 else row[-1][-1] <= found <= common(a, b)


@pytest.mark.parametrize("percent", [1, 2, 4, 6, 8, 10])
def test_recall_at_edit_rates(spark, percent):
    """Texts of 60, 150 and 400 words and a copy of each with so many words replaced: all pairs are at 0.8 or above."""
    r, docs = random.Random(percent), []
    for base in range(150):
        w = text(1000 * percent + base, (60, 150, 400)[base % 3]).split()
        u = list(w)
        for at in r.sample(range(len(w)), max(1, len(w) * percent // 100)):
            u[at] = "zz%d" % r.randrange(10**6)
        docs += [(2 * base, " ".join(w), "en", "a"), (2 * base + 1, " ".join(u), "en", "a")]
    rows = N.near_duplicate_report(documents(spark, docs, extra=False)).collect()
    assert sum(x.class_id != x.doc_id for x in rows) >= 0.9 * 150
    assert all(x.class_id // 2 == x.doc_id // 2 for x in rows)


def test_order_matters():
    a, b = text(1, 60), text(2, 60)
    x, y = N.word_hashes(f"{a} {b}"), N.word_hashes(f"{b} {a}")
    assert N.similarity(x, y, 0.0) < 0.6
    assert N.similarity(x, x, 0.8) == 1.0


def test_sketch_collisions_follow_similarity():
    t = text(3, 400)
    near, far = edited(t, 6, 1), text(4, 400)
    k = N.sketches(N.kmers(t))[0]
    assert (k == N.sketches(N.kmers(near))[0]).sum() >= 4
    assert (k == N.sketches(N.kmers(far))[0]).sum() == 0


def test_occurrence_labels():
    s = N.kmers("a a a a a a a a")
    assert len(np.unique(s)) == 1
    assert len(np.unique(N.labelled(s))) == 4
