"""Operators and pipeline stages against versions that know nothing of theirs: plain Python over the whole fixture, or SQL."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.cases import ROWS, documents, text
from tests.llm.test_near_duplicates import brute
from tests.llm.test_sharding_mixing import brute_targets
from tests.llm.test_text_operators import base_by_rule, prose
from tests.test_queries import rows as comparable
from tileflow.llm import language_id as L
from tileflow.llm import queries
from tileflow.llm import quality_classifier as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "odd"), [(n, odd) for n in sorted(queries.oracle_sql()) for odd in (False, True) if not odd or n.startswith(("op7", "op9"))])
def test_sql(spark, tmp_path, name, odd):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    where = SF
    if odd:
        where = str(tmp_path)
        same = [(5, text(9, 30), "en", "a")] * 7 + [(None, text(9, 30), "en", "a")] * 9 + [(i, text(i, 12), "en", "a") for i in range(100, 130)]
        rows = ROWS + same
        if name.startswith("op7"):  # its SQL joins by id, so ids are unique there
            rows = [(n, *rest) for n, (_, *rest) in enumerate(rows)]
        documents(spark, rows, extra=False).write.parquet(f"{where}/documents.parquet")
    duck = duckdb.connect()
    for table in ("documents",) if odd else ("documents", "conversations", "sale_lines"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet{'/*.parquet' if odd else ''}'")
    got, want = queries.queries()[name](spark, where).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


# --- language ---------------------------------------------------------------


def grams(t):
    words = re.findall(r"[^\W\d_]+", t.lower())
    out = Counter()
    for w in words:
        out.update(w)
    padded = f" {' '.join(words)} " if words else ""
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    out.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return out


def ranking(counts):
    """n-gram -> rank; ties share their mean rank. The order within ties at the cut does not matter here: no profile is cut."""
    order = sorted(counts.values(), reverse=True)
    return {g: (order.index(n) + len(order) - 1 - order[::-1].index(n)) / 2 for g, n in counts.items()}


def test_language_by_brute_force(spark):
    docs = [(i, prose(lang := "xyz"[i % 3] * 2, i, 2 + i % 5), lang, "a") for i in range(90)] + [(900, "Привет мир", "xx", "a"), (901, "12 34", "yy", "a"), (902, None, "yy", "a")]
    top = 10_000  # nothing is cut
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts = defaultdict(Counter)
    for lang in ("xx", "yy", "zz"):
        for i, t, own, _ in docs:
            if own == lang and not held(i) and t:
                counts[lang].update(grams(t))
    profiles = {k: ranking(c) for k, c in counts.items()}
    learned = L.learn(documents(spark, [d for d in docs if not held(d[0])]), top=top)
    found = {r.doc_id: r for r in L.predicted(documents(spark, docs), learned).collect()}
    for i, t, *_ in docs:
        mine = ranking(grams(t or ""))
        if not mine:
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        far = {k: sum(abs(p[g] - r) if g in p else top for g, r in mine.items()) for k, p in profiles.items()}
        best, second = sorted(far.values())[:2]
        assert far[found[i].lang_pred] == pytest.approx(best)
        assert found[i].score == pytest.approx(second / (best + second))


# --- quality ----------------------------------------------------------------


def plain_statistics(t):
    import unicodedata

    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    if not words:
        return [0.0] * 16
    kind = lambda c: unicodedata.category(c) if ord(c) < 0x10000 else "Lo"
    solid = max(sum(c not in " \t\n\x0b\x0c\r" for c in t), 1)
    share = lambda f: math.sqrt(sum(map(f, t)) / solid)
    n, lengths = len(words), [len(w) for w in words]
    mean = sum(lengths) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in lengths) / n)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [
        math.log(1 + n), math.log(mean), math.log(1 + sd), share(lambda c: kind(c)[0] == "L"), share(lambda c: kind(c) == "Lu"), share(lambda c: kind(c)[0] == "N"),
        share(lambda c: c in "#*$%&|<>" or kind(c)[0] == "S"), share(lambda c: kind(c)[0] == "P"), math.sqrt(t.count("!") / n), math.sqrt(t.count("|") / n), math.sqrt(len(set(words)) / n),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), math.sqrt(Counter(words).most_common(1)[0][1] / n), math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log(1 + n / (1 + len(re.findall("[.!?]", t)))), math.sqrt(sum(w.isupper() for w in words) / n),
    ]


def plain_scores(docs, labels):
    """(id, text), (id, 0 or 1) of the training rows -> score of each document, by the densities as they are defined."""
    x = {i: np.array(plain_statistics(t)) for i, t in docs}
    of = {c: np.array([x[i] for i, y in labels if y == c and i in x]) for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in of.items()}
    n = {c: len(v) for c, v in of.items()}
    pooled = sum(cov[c] * n[c] for c in (0, 1)) / sum(n.values())
    log = {}
    for c in (0, 1):
        s = (1 - Q.TO_POOLED) * cov[c] + Q.TO_POOLED * pooled
        s = (1 - Q.TO_DIAGONAL) * s + Q.TO_DIAGONAL * np.diag(np.diag(s)) + Q.RIDGE * np.eye(16)
        inverse, det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        log[c] = {i: -0.5 * ((v - of[c].mean(0)) @ inverse @ (v - of[c].mean(0)) + det) + math.log(n[c]) for i, v in x.items()}
    return {i: 1 / (1 + math.exp(min(700, log[0][i] - log[1][i]))) for i in x}


@pytest.mark.parametrize("t", ["", " \n", "One two. Two, THREE!\n\nOne two. Two, THREE!\n", "é 你好 x² \U0001f600 A|B # 12", "a a a a\x1cb\tc", "!!!"])
def test_statistics(t):
    assert Q.statistics(t) == pytest.approx(plain_statistics(t))


def test_scores_by_brute_force(spark):
    r = random.Random(6)
    docs = [(i, " ".join([text(i, 20)] * (1 + (i % 4 == 0) * 5)) + r.choice([".", "!", " # # #", "\nx\nx"]), "en", "a") for i in range(300)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 300, 1)]
    want = plain_scores([d[:2] for d in docs], [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2])
    rows = Q.quality_scores(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {row.doc_id: row.score for row in rows} == pytest.approx(want, abs=1e-6)


# --- pipeline ---------------------------------------------------------------


def test_pipeline_by_brute_force(spark):
    """Every stage on what its predecessor kept, against rules in plain Python."""
    import corpus_pipeline as C

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    step = dict(C.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    score = plain_scores(rows, [(i, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2])
    kept = step["quality classifier"](spark, docs, SF)
    good = {r.doc_id for r in kept.collect()}
    sure = {i for i, s in score.items() if abs(s - 0.7) > 1e-6}
    assert good & sure == {i for i, s in score.items() if s >= 0.7} & sure

    rows = [(i, t) for i, t in rows if i in good]
    single = step["minhash near-dedup"](spark, kept, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(group) for group in brute(rows))

    clean = step["secret scans"](spark, single, SF)
    before = {r.doc_id: r for r in single.collect()}
    assert clean.count() == len(before)
    for r in clean.collect():
        was = before[r.doc_id]
        assert (r.lang, r.source, r.n_chars) == (was.lang, was.source, len(r.text))
        assert all(was.text[s:e] not in r.text for _, s, e in base_by_rule(was.text))
        pieces = [re.escape(x) for x in r.text.split("[SECRET]")]
        assert re.fullmatch(".+?".join(pieces), was.text, re.S), "nothing but spans is replaced"

    mixed = step["source mixing"](spark, clean, SF)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in clean.collect():
        sizes[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    copies = Counter()
    for r in mixed.collect():
        taken[r.source] += words(r.text)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    assert all(abs(taken[s] - t) <= longest[s] for s, t in brute_targets(sizes).items())

    from tests.llm.test_packing import check
    from tileflow.llm import packing

    sequences, least = check(step["best-fit packing"](spark, mixed, SF).collect(), [(r.doc_id, r.text) for r in mixed.collect()], packing.encoder(packing.default_tokenizer()))
    assert sequences <= 1.02 * least + 2


def test_pipeline_on_odd_rows(spark):
    """Nulls, repeats, very long and empty texts, clashing columns: each stage's rows, by hand."""
    import corpus_pipeline as C

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    step = dict(C.STAGES)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    everything = Counter(i for i, *_ in ROWS)
    want = {"minhash near-dedup": Counter([1, ROWS[2][0], 4, 5, 6, 7, 8, None, None, 11, 12]), "secret scans": everything}
    for name, stage in step.items():
        assert stage(spark, documents(spark, []), SF).count() == 0, name
        out = stage(spark, documents(spark), SF)
        if name != "best-fit packing":
            assert out.columns == list(C.COLUMNS), name
        if name in want:
            assert ids(out) == want[name], name
    assert not ids(step["quality classifier"](spark, documents(spark), SF)) - everything
    pieces = step["best-fit packing"](spark, documents(spark), SF).where("piece = 0")
    assert ids(pieces) == everything
