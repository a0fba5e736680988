import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import BIG, documents
from tileflow.llm import embedding_duplicates as E

SCHEMA = "vec_id long, embedding array<float>, label int, fp string"


def brute(rows, least=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, near = Counter(), defaultdict(set)
    for a in range(len(ok)):
        for b in range(len(ok)):
            x, y = ok[a][1], ok[b][1]
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[a] += 1
                near[a].add(b)
    comp = {}
    for a in range(len(ok)):
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in near[todo.pop()] if b not in seen and not seen.add(b)]
        comp[a] = min(ok[x][0] for x in seen)
    return Counter((ok[a][0], links[a], comp[a]) for a in range(len(ok)))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def cloud(n, dim=64, seed=0):
    r = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        c = r.normal(size=dim)
        for _ in range(r.integers(1, 6)):
            v = c + r.normal(size=dim) * r.uniform(0, 0.3) if r.random() < 0.9 else c
            rows.append((i, np.float32(v).tolist()))
            i += 1
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = cloud(250, seed=seed)
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in E.embedding_report(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_recall_at_the_threshold():
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = r.normal(size=x.shape)
    d -= (d * x).sum(axis=1)[:, None] * x
    d /= np.linalg.norm(d, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * d
    a, b = E.cells(x), E.cells(y)
    met = (a[:, :, 0] == b[:, :, 0]) | (b[:, :, 1:] == a[:, :, :1]).any(axis=2) | (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
    assert met.any(axis=1).mean() > 0.998


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    r = np.random.default_rng(5)
    c = r.normal(size=64)
    rows = [(i, np.float32(c + r.normal(size=64) * 0.17).tolist()) for i in range(150)] + [(500 + i, np.float32(c).tolist()) for i in range(50)]
    got = Counter((x.vec_id, x.n_links, x.component_id) for x in E.embedding_report(frame(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("small", [1, 5, 64])
def test_pairs_of_groups(monkeypatch, small):
    """Every pair of a group once, if one of the two lies in the cell and the blocks are those that meet."""
    import pandas as pd

    monkeypatch.setattr(E, "SMALL", small)
    r = np.random.default_rng(small)
    rows = []
    for cell in range(40):
        i, j = (0, 0) if cell % 2 else (0, 1)
        rows += [(cell, i, j, int(r.integers(i, j + 1)), bool(r.random() < 0.4)) for _ in range(r.integers(2, 12))]
    g = pd.DataFrame(rows, columns=["cell", "i", "j", "block", "own"])
    a, b = E.pairs(g, g["cell"].to_numpy(), lambda a, b, crossed: np.ones((len(a), len(b)) if crossed else len(a), bool))
    got = Counter(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
    want = [(x, y) for y in range(len(rows)) for x in range(y) if rows[x][0] == rows[y][0] and (rows[x][4] or rows[y][4]) and (rows[x][1] == rows[x][2] or rows[x][3] != rows[y][3])]
    assert got == Counter(want)


def test_odd_rows(spark):
    one = np.float32(np.random.default_rng(1).normal(size=8)).tolist()
    rows = [(1, one), (BIG, one), (3, None), (4, []), (5, [0.0] * 8), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [float("inf"), 1.0]), (None, one), (9, one[:7]), (1, one), (10, [x * 1e30 for x in one]), (11, [x * 1e-30 for x in one])]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_report(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[1] == (1, 4, 1, True)
    assert by[BIG] == (BIG, 4, 1, False)
    assert by[10] == (10, 4, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert by[i] == (i, 0, i, True)
    assert by[None] == (None, 0, None, False)
    assert E.embedding_report(frame(spark, []).limit(0)).count() == 0


def test_decoder_is_nearest():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 8)) * 2
    p = E.decode(x)
    assert (np.abs(p * 2 - np.rint(p * 2)) < 1e-9).all()
    d = ((x - p) ** 2).sum(axis=1)
    other = ((x[:, None, :] - (p[:, None, :] + E.ROOTS)) ** 2).sum(axis=2).min(axis=1)
    assert (d <= other + 1e-9).all()
    assert len(E.ROOTS) == 240
    assert np.allclose((E.ROOTS**2).sum(axis=1), 2)


# --- pipeline ---------------------------------------------------------------


def test_stages_by_hand(spark):
    import corpus_pipeline as C
    from tileflow.llm import mixing, near_duplicates, packing, quality_classifier, secrets

    assert [n for n, _ in C.STAGES] == ["quality classifier", "minhash near-dedup", "secret scans", "source mixing", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality_classifier.quality_scores(docs, labels).where("predicted = 1").collect()}
    step = C.quality(spark, docs, sf)
    assert {r.doc_id for r in step.collect()} == good
    kept = {r.doc_id for r in near_duplicates.near_duplicate_report(step).where("kept").collect()}
    step = C.near_dedup(spark, step, sf)
    assert {r.doc_id for r in step.collect()} == kept
    step = C.secret_scan(spark, step, sf)
    for r in step.collect():
        assert r.text == secrets.redact(rows[r.doc_id].text, secrets.scan(rows[r.doc_id].text)[1])
        assert r.n_chars == len(r.text)
    want = Counter({r.doc_id: r.taken // r.size for r in mixing.mix_report(step).where("size > 0").collect() if r.taken})
    step = C.mix(spark, step, sf)
    assert Counter(r.doc_id for r in step.collect()) == want
    assert step.columns == list(C.COLUMNS)
    out = C.pack(spark, step, sf)
    assert Counter(r.doc_id for r in out.where("piece = 0").collect()) == want
    assert C.run(spark, sf).count() == out.count()


def test_queries_are_registered():
    import __spark_entry__ as e

    found = [re.match(r"op(\d+)_", n) for n in e.queries()]
    assert sorted(int(m[1]) for m in found if m) == list(range(1, 14))
    assert "pipeline" in e.queries()
