import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import BIG, ROWS, documents, text
from tileflow.llm import mixing, sharding


def check_shards(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(v) == list(range(len(v))) and 0 <= k < shards for k, v in slots.items())
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    return size


def test_odd_rows(spark):
    check_shards(sharding.shard_report(documents(spark)).collect(), ROWS, 8)


def test_empty(spark):
    assert sharding.shard_report(documents(spark, [])).count() == 0


def test_near_equal_and_copies_together(spark):
    docs = [(i, text(i % 1500, 40), "en", "a") for i in range(3000)]
    rows = sharding.shard_report(documents(spark, docs)).collect()
    size = check_shards(rows, docs, 8)
    assert max(size.values()) <= 1.02 * min(size.values())
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 7


def test_one_text_is_most_rows(spark):
    docs = [(i, "same text" if i % 3 else text(i, 3), "en", "a") for i in range(3000)]
    size = check_shards(sharding.shard_report(documents(spark, docs)).collect(), docs, 8)
    assert max(size.values()) <= 1.05 * min(size.values())


@pytest.mark.parametrize("slice_bytes", [100, 700, 10_000])
def test_slices_number_a_shard_without_gaps(spark, slice_bytes):
    docs = [(i, "same text" if i % 3 == 0 else "other text, much longer" if i % 3 == 1 else text(i, 8), "en", "a") for i in range(1500)] + [(None, None, None, None)] * 3
    out = sharding.shard(documents(spark, docs), 4, slice_bytes=slice_bytes).select("doc.doc_id", "size", "shard", "slot").collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == len(docs)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    assert max(size.values()) <= 1.05 * min(size.values())


def test_a_text_over_the_edge_of_a_range_is_sliced(spark):
    """Two texts, one with most rows: wherever ranges begin and end in it, its rows are dealt to slices; slices rise with the key."""
    docs = [(i, "same text" if i % 10 else text(i, 3), "en", "a") for i in range(4000)]
    rows = sharding.keyed(documents(spark, docs, extra=False), "doc_id", "text", [F.col("doc_id")]).cache()
    (k,) = {r.k for r in rows.groupBy("k").count().where("count > 1000").collect()}
    keys = [(k // 2, 0), (k, sharding.TOP // 3), (k, sharding.TOP // 2), (k + 5, 7)]
    placed = rows.withColumn("range_no", sharding.range_of(keys).cast("int"))
    got = placed.withColumn("slice_no", sharding.slice_of(keys, 8)).collect()
    count = Counter((r.range_no, r.slice_no) for r in got if r.k == k)
    assert {n for n, _ in count} == {1, 2, 3}
    assert max(count.values()) < 1.5 * 3600 * max(1 / 3, 1 / 6, 1 / 2) / 8
    in_order = sorted(got, key=lambda r: (r.k, r.h))
    assert [(r.range_no, r.slice_no) for r in in_order] == sorted((r.range_no, r.slice_no) for r in got)


def test_documents_keep_their_columns(spark):
    out = sharding.shard(documents(spark), 2)
    assert set(out.columns) == {"doc", "size", "shard", "slot"}
    assert out.where("doc.doc_id IS NOT NULL").agg(F.max("doc.doc_id")).first()[0] == BIG


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("sources", [["a", "b", "c", None], ["z", "é", "B", "b", "\U0001f600", "￿", None], ["only"]])
def test_targets(spark, sources):
    docs = [(i, text(i, 5 + i % 50 * (1 + i % len(sources)) ** 2 // 4), "en", sources[i * i % 7 % len(sources)]) for i in range(600)]
    got = mixing.mix_report(documents(spark, docs)).collect()
    size = {i: len(t.split()) for i, t, *_ in docs}
    of = {i: s for i, _, _, s in docs}
    sizes = Counter()
    for i, n in size.items():
        sizes[of[i]] += n
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        s = of[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(size.values())
    assert sorted(got, key=lambda r: r.doc_id) == sorted(mixing.mix_report(documents(spark, docs)).collect(), key=lambda r: r.doc_id)


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows"])
def test_shared_ids_are_split(spark, kind):
    """Nine in ten rows without an id, with one id, or equal altogether: every source still comes within a document of its target."""
    shared = {"null ids": lambda i: None, "one id": lambda i: 7, "equal rows": lambda i: None}[kind]
    docs = [(i if i % 10 == 0 else shared(i), text(3, 20) if kind == "equal rows" and i % 10 else text(i, 20), "en", "abc"[i % 3]) for i in range(1000)]
    got = mixing.mix_report(documents(spark, docs))
    docs_by = mixing.mixed_documents(documents(spark, docs)).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words")).collect()
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    assert {r.source for r in docs_by} == set(want)
    assert all(abs(r.words - want[r.source]) <= 20 for r in docs_by)
    assert got.agg(F.sum("taken")).first()[0] == sum(r.words for r in docs_by)
    assert Counter(got.collect()) == Counter(mixing.mix_report(documents(spark, docs).repartition(7)).collect())


def test_mix_odd_rows(spark):
    got = mixing.mix_report(documents(spark)).collect()
    assert len(got) == len(ROWS)
    assert Counter(r.size for r in got if r.doc_id in (4, 5, 6, 7)) == Counter([0, 0, 0, 1])
    assert mixing.mix_report(documents(spark, [])).count() == 0
    zero = mixing.mix_report(documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert {(r.target, r.taken) for r in zero} == {(0.0, 0)}


def test_mixed_documents_follow_the_report(spark):
    docs = documents(spark)
    want = Counter()
    for r in mixing.mix_report(docs).where("size > 0 AND doc_id IS NOT NULL").collect():
        want[r.doc_id] += r.taken // r.size
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.where("text IS NOT NULL AND doc_id IS NOT NULL").collect() if (r.text or "").split())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_budgets_are_nested(spark):
    rows = documents(spark, [(i, text(i, 20), "en", "a" if i % 3 else "b") for i in range(500)], extra=False)
    m = mixing.measured(rows).select(F.col("doc.doc_id").alias("doc_id"), "source", "size", "hk", "row").cache()
    below = [{r.source: r.below for r in mixing.thresholds(m, w).collect() if r.whole == 0} for w in ((1, 2, 3), (1, 4, 3))]
    assert below[0]["a"] < 1 << 60
    assert below[1]["a"] <= below[0]["a"]
