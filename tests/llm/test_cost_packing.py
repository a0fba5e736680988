import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, documents, text
from tileflow.llm import cost_packing as C


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(C.default_tokenizer())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def check(rows, docs, plain, length=4096):
    """Every id of every row lies in one piece; sequences have no gap and no padding; returns their costs."""
    want, got = defaultdict(list), defaultdict(list)
    for i, t, *_ in docs:
        want[i].append([*plain(t or ""), 2])
    for r in rows:
        got[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for i, texts in want.items():
        for ids in texts:
            left, at = got[i, len(ids)], 0
            while at < len(ids):  # rows may repeat: take a piece that goes on from here and has these ids
                p = next(p for p in sorted(left) if p[0] == at and p[2] == zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes()))
                left.remove(p)
                at += p[1]
    assert not any(got.values())
    seqs, costs = defaultdict(list), defaultdict(float)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        costs[r.sequence_id] += C.LINEAR * r.length + C.QUADRATIC * r.length**2
    used = []
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0
        used.append(at)
    assert sum(u == length for u in used) == sum(used) // length
    return {q: c for q, c in costs.items() if sum(n for _, n in seqs[q]) == length}


def test_odd_rows(spark, plain):
    check(C.cost_packing_report(documents(spark)).collect(), ROWS, plain)
    assert C.cost_packing_report(documents(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [C.CHUNK, 9000])
def test_costs_are_near(spark, plain, monkeypatch, chunk):
    """Also through a tree of several levels: chunks of two sequences, whose rests fill sequences above."""
    docs = [(i, text(i, 5 + i * 37 % 400), "en", "a") for i in range(500)]
    rows = C.packed_by_cost(documents(spark, docs).repartition(9), C.default_tokenizer(), chunk=chunk).collect()
    costs = check(rows, docs, plain)
    if chunk == C.CHUNK:
        assert max(costs.values()) < 1.1 * min(costs.values())


def test_sequences_hold_the_ids(spark, plain):
    docs = [(i, text(i, 300), "en", "a") for i in range(30)] + [(3, text(3, 300), "en", "a")]
    rows = C.sequences(documents(spark, docs)).collect()
    got = sorted(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist())
    assert got == sorted(i for _, t, *_ in docs for i in [*plain(t), 2])
    assert all(len(r.doc_ids) == len(r.offsets) and r.cost > 0 for r in rows)


def test_repeated_rows_of_one_length_spread(spark, plain):
    docs = [(1, "same words here", "en", "a")] * 3000
    check(C.packed_by_cost(documents(spark, docs).repartition(5), C.default_tokenizer(), chunk=5000).collect(), docs, plain)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_the_tokenizer(t):
    own = Tokenizer.from_file(C.default_tokenizer())
    own.encode_special_tokens = True
    assert list(C.word_encoder(C.default_tokenizer())(t)) == own.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 32))
def test_balanced_by_the_definition(lengths, longest):
    """Against a plain program: of all sequences with room, the cheapest, the first of these."""
    placed, rest = C.balanced(lengths, 32, longest, 1.0, 0.25)
    n = sum(lengths) // 32
    cost, used, plainly = [0.0] * n, [0] * n, []
    items = [(min(longest, x - s), d, s) for d, x in enumerate(lengths) for s in range(0, x, longest)]
    while any(u < 32 for u in used):
        items.sort(key=lambda x: (-x[0], x[1], x[2]))
        size, d, s = items.pop(0)
        q = min((q for q in range(n) if used[q] < 32), key=lambda q: (cost[q], q))
        take = min(size, 32 - used[q])
        plainly.append((d, s, take, q, used[q]))
        used[q] += take
        cost[q] += take + 0.25 * take * take
        if take < size:
            items.append((size - take, d, s + take))
    assert placed == plainly
    assert sorted(rest) == sorted((d, s, x) for x, d, s in items)
    tail = C.in_powers_of_two(rest, 7)
    assert sum(x[2] for x in tail) == sum(x[2] for x in rest)
