import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, documents, text
from tileflow.llm import packing as P


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def check(rows, docs, plain):
    want = Counter()
    for i, t, *_ in docs:
        ids = [*plain(t or ""), 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            want[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return len(seqs), -(-sum(r.length for r in rows) // 1024)


def test_odd_rows(spark, plain):
    check(P.packing_report(documents(spark)).collect(), ROWS, plain)
    assert P.packing_report(documents(spark, [])).count() == 0


def test_few_sequences(spark, plain):
    docs = [(i, text(i, 20 + i * 37 % 700), "en", "a") for i in range(1200)]
    n, least = check(P.packing_report(documents(spark, docs)).collect(), docs, plain)
    assert n <= least * 1.01 + 2


def test_tree_of_small_nodes(spark, plain, monkeypatch):
    monkeypatch.setattr(P, "NODE", 80)
    docs = [(i, text(i, 20 + i * 37 % 200), "en", "a") for i in range(600)]
    n, least = check(P.packing_report(documents(spark, docs).repartition(8)).collect(), docs, plain)
    assert n <= least * 1.05 + 2


@pytest.mark.parametrize("leaf", [100_000, 1000])
def test_input_sorted_by_length(spark, monkeypatch, leaf):
    """Partitions of long and of short pieces: 3,000 sequences where each is packed for itself, 2,000 by one best fit."""
    monkeypatch.setattr(P, "LEAF", leaf, raising=False)
    parts = spark.range(0, 4000, 1, 2).selectExpr("id AS doc_id", "CASE WHEN id < 2000 THEN 600L ELSE 400L END AS length")
    rows = P.packed(parts).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    assert max(used.values()) <= 1024
    assert len(used) <= (2000 if leaf > 4000 else 2100)


def test_no_bin_is_closed_before_its_time(spark, monkeypatch):
    """Bins that only other leaves' bins can fill, many times what a node holds: the rounds still join nearly all."""
    monkeypatch.setattr(P, "LEAF", 500)
    monkeypatch.setattr(P, "NODE", 100)
    parts = spark.range(0, 6000, 1, 3).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 600L ELSE 424L END AS length")
    rows = P.packed(parts).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    assert len({r.sequence_id for r in rows}) <= 3000 * 1.04
    alike = P.packed(spark.range(0, 3000, 1, 3).selectExpr("id AS doc_id", "600L AS length")).collect()
    assert len({r.sequence_id for r in alike}) == 3000


def test_sequences_hold_the_ids(spark, plain):
    docs = [(i, text(i, 300), "en", "a") for i in range(20)] + [(3, text(3, 300), "en", "a")]
    rows = P.sequences(documents(spark, docs)).collect()
    total = Counter()
    for r in rows:
        assert len(r.ids) <= 1024
        total.update(r.ids)
    want = Counter()
    for _, t, *_ in docs:
        want.update([*plain(t), 2])
    assert total == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_the_tokenizer(t):
    own = Tokenizer.from_file(P.default_tokenizer())
    own.encode_special_tokens = True
    assert list(P.encoder(P.default_tokenizer())(t)) == own.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_never_overfills(sizes):
    s = np.array(sorted(sizes, reverse=True), np.int64)
    b = P.best_fit(s, 64)
    if len(s):
        used = np.bincount(b, weights=s)
        assert used.max() <= 64
        assert len(used) <= max(1, int(1.3 * -(-s.sum() // 64)) + 2, (s > 32).sum())


def test_cuts():
    assert P.cuts(1) == [(0, 1)]
    assert P.cuts(1024) == [(0, 1024)]
    assert P.cuts(1025) == [(0, 1), (1, 1024)]
    assert P.cuts(2048) == [(0, 1024), (1024, 1024)]


def test_very_long_runs(plain):
    e = P.encoder(P.default_tokenizer())
    for t in (" " * 200_000, "a" * 200_000, "\n" * 50_000):
        assert list(e(t)) == plain(t)


def test_rounds_end_without_progress(spark, monkeypatch):
    """132 bins of which no two fit, at nodes of 100."""
    monkeypatch.setattr(P, "NODE", 100)
    parts = spark.range(0, 132, 1, 3).selectExpr("id AS doc_id", "600L AS length")
    for stall in (P.STALL, 0):
        rows = P.packed(parts, stall=stall).collect()
        assert len({r.sequence_id for r in rows}) == len(rows) == 132
