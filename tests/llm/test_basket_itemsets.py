import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tileflow.llm import basket_itemsets as B

SCHEMA = "sale_id long, item_id long, flag string, n long, mark string, path string, items string, class string"


def lines(spark, rows):
    return spark.createDataFrame([(s, i, "kept", 1, "x", "x", "x", "x") for s, i in rows], SCHEMA)


def plainly(rows, least=5, one_in=20_000):
    """All subsets of all baskets, counted."""
    baskets = {}
    for s, i in rows:
        if s is not None and i is not None:
            baskets.setdefault(s, set()).add(i)
    least = max(least, -(-len(baskets) // one_in))
    n, level = {}, {(): list(baskets.values())}
    while level:
        deeper = {}
        for own, held in level.items():
            for i in {i for b in held for i in b if not own or i > own[-1]}:
                found = [b for b in held if i in b]
                if len(found) >= least:
                    deeper[(*own, i)] = found
        n |= {k: len(v) for k, v in deeper.items()}
        level = deeper
    bigger = {(k[:j] + k[j + 1 :], v) for k, v in n.items() for j in range(len(k))}
    out = set()
    for k, v in n.items():
        if (k, v) in bigger:
            continue
        rules = []
        for c in k if len(k) > 1 else ():
            a, s = n[tuple(i for i in k if i != c)], n[(c,)]
            if 100 * v >= 60 * a and v * len(baskets) > a * s:
                rules.append((c, a, s))
        best = min(((a, c) for c, a, s in rules), default=(None, None))[1]
        out.add((",".join(map(str, k)), len(k), v, len(rules), best, hashlib.sha256(";".join(f"{c}:{a}:{s}" for c, a, s in rules).encode()).hexdigest()))
    return out


def got(spark, rows, **parameters):
    found = [tuple(r) for r in B.itemset_report(lines(spark, rows), **parameters).collect()]
    assert len(found) == len(set(found))
    return set(found)


def shop(seed, baskets=250, items=14, repeat=True):
    """Items that go together, baskets that are copies, a basket of everything, nulls and repeated lines."""
    r = random.Random(seed)
    rows = []
    for s in range(baskets):
        own = {i for i in range(items) if r.random() < 0.9 / (1 + i % 7)}
        if 2 in own:
            own |= {3, 9}
        rows += [(s, i) for i in own]
    rows += [(s, i) for s in range(baskets, baskets + 9) for i in range(4, 4 + items // 2)]
    rows += [(baskets + 9, i) for i in range(items + 30)]
    rows += [(None, 1), (5, None), (None, None), (baskets + 20, None)]
    return rows + rows[: len(rows) // 3] * repeat


def test_equals_all_subsets(spark):
    rows = shop(1)
    want = plainly(rows)
    assert len(want) > 50 and any(x[3] for x in want)
    assert got(spark, rows) == want


@pytest.mark.parametrize(("class_rows", "short"), [(4, 6), (4, 2), (B.CLASS_ROWS, 2)])
def test_classes_dealt_out_again_and_long_baskets(spark, monkeypatch, class_rows, short):
    monkeypatch.setattr(B, "SHORT", short)
    rows = shop(2, baskets=90, items=9)
    assert got(spark, rows, class_rows=class_rows) == plainly(rows)


def test_least_share(spark):
    rows = shop(3, baskets=120, items=8)
    assert got(spark, rows, one_in=8) == plainly(rows, one_in=8)


def test_empty_and_infrequent(spark):
    assert got(spark, []) == set()
    assert got(spark, [(1, 2), (1, 3), (None, None)]) == set()
    assert got(spark, [(s, 7) for s in range(5)]) == {("7", 1, 5, 0, None, hashlib.sha256(b"").hexdigest())}


paths = st.lists(st.lists(st.integers(0, 7), min_size=1, max_size=6, unique=True), min_size=1, max_size=25)


@settings(max_examples=150, deadline=None)
@given(paths, st.integers(1, 4))
def test_lists_by_the_definition(found, least):
    arrays = [np.array(sorted(p), np.int64) for p in found]
    marks = np.arange(1, len(arrays) + 1, dtype=np.int64) * 7919
    lists = B.n_lists(arrays, np.ones(len(arrays), np.int64), marks)
    sets = [set(p) for p in found]
    for items in [c for k in (1, 2, 3) for c in combinations(sorted({i for p in found for i in p}), k)]:
        assert B.support_in({i: (k, x) for k, (i, x) in enumerate(lists)}, list(items)) == sum(set(items) <= s for s in sets)
    closed = {}
    for items, n, mark in B.closed_sets(lists, least, [99], len(sets), int(np.bitwise_xor.reduce(marks))):
        held = [k for k, s in enumerate(sets) if set(items) - {99} <= s]
        assert len(held) == n and int(np.bitwise_xor.reduce(marks[held])) == mark
        closed[tuple(items)] = n
    for a in combinations(range(min(len(sets), 7)), 2):  # what two baskets share is closed, and found if often enough
        common = sets[a[0]] & sets[a[1]]
        if sum(common <= s for s in sets) >= least:
            assert tuple(sorted(common | {99})) in closed
