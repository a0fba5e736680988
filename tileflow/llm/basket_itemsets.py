"""Closed frequent itemsets of baskets, and their rules, by prefix trees whose nodes carry pre- and post-order codes.

Items are ordered from the most frequent on. The class of a suffix item holds, for each basket with that item, the path of the items
before it that occur with it often enough; equal paths are one row with a weight. Classes are dealt to tasks. A task
builds the prefix tree of its class and gives every item its N-list: (pre, post, count) of the item's nodes. A node lies below
another if its pre-order is higher and its post-order lower, so one merge of two lists gives the list of both items
together, and its counts their support. An item that all baskets of a set hold joins it at once; an item whose
baskets a deeper one all holds opens no branch of its own. Sets of different classes with the same baskets meet
by support and by the exclusive or of their baskets' hashes, which lists carry along: all but the largest that contains them go.

The supports that rules need, of a closed set less one item, are merged in the class of their own suffix.

What keeps this even: the few longest baskets (at most half the least support) are never turned into pairs: their
pairs only count where the other baskets alone come near the least support, so a pair is looked up in them, by joins.
A class of more than ``class_rows`` different paths is dealt out again by its next item, as often as needed.
Frequent items number at most ``one_in`` times the items of a mean basket.

Defined results
    Lines without basket or item are no lines. Repeated lines count once. Empty table, or no item frequent: no
    rows. Ties in frequency: by item. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.scratch import stage

LEAST, ONE_IN = 5, 20_000
CONFIDENCE = 60
#: Different paths of a class that one task mines.
CLASS_ROWS = 200_000
#: Baskets of fewer than 2^SHORT items are always turned into pairs.
SHORT = 6

List = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # pre, post, count, mark


def n_lists(paths: list[np.ndarray], weights: np.ndarray, marks: np.ndarray) -> list[tuple[int, List]]:
    """(item, N-list) of the prefix tree of the paths, items from the top of the tree down: most frequent first."""
    owner = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
    items, code = np.unique(np.concatenate(paths), return_inverse=True)
    order = np.lexsort((items, -np.bincount(code, weights=weights[owner])))
    rank = np.empty(len(items), np.int64)
    rank[order] = np.arange(len(items))
    ranked = rank[code]
    by_path = np.lexsort((ranked, owner))
    cut = np.cumsum([len(p) for p in paths])[:-1]
    rows = sorted(zip([p.tolist() for p in np.split(ranked[by_path], cut)], weights.tolist(), marks.tolist(), strict=True))
    label: list[int] = []
    post: list[int] = []
    count: list[int] = []
    mark: list[int] = []
    above: list[int] = []
    before: list[int] = []
    left = 0

    def leave(depth: int) -> None:
        nonlocal left
        while len(above) > depth:
            node = above.pop()
            post[node] = left
            left += 1
            if above:
                count[above[-1]] += count[node]
                mark[above[-1]] ^= mark[node]

    for path, w, m in rows:
        k, most = 0, min(len(path), len(before))
        while k < most and path[k] == before[k]:
            k += 1
        leave(k)
        for x in path[k:]:
            above.append(len(label))
            label.append(x)
            post.append(0)
            count.append(0)
            mark.append(0)
        count[above[-1]] += w
        mark[above[-1]] ^= m
        before = path
    leave(0)
    labels, columns = np.array(label), [np.array(c, np.int64) for c in (post, count, mark)]
    pre = np.argsort(labels, kind="stable")  # nodes are numbered in pre-order
    parts = np.split(pre, np.searchsorted(labels[pre], np.arange(1, len(items))))
    return [(int(items[order[r]]), (p, *[c[p] for c in columns])) for r, p in enumerate(parts)]


def merged(upper: List, lower: List) -> List | None:
    """N-list of two sets together: nodes of upper that have nodes of lower below them, with the counts of these. Both are
    ascending in pre and post, so it is one pass over both."""
    at = np.searchsorted(upper[0], lower[0]) - 1
    below = (at >= 0) & (upper[1][at] > lower[1])
    at = at[below]
    if not len(at):
        return None
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    keep = at[first]
    return upper[0][keep], upper[1][keep], np.add.reduceat(lower[2][below], first), np.bitwise_xor.reduceat(lower[3][below], first)


def closed_sets(lists: list[tuple[int, List]], least: int, suffix: list[int], support: int, mark: int) -> Iterator[tuple[list[int], int, int]]:
    """(items, support, mark) of sets of a class: all that are closed among the items of the class, and few others."""
    stack = [(suffix, support, mark, [(i, n, int(n[2].sum())) for i, n in lists])]
    while stack:
        own, n, m, more = stack.pop()
        own = own + [i for i, _, s in more if s == n]
        more = [e for e in more if e[2] < n]
        yield sorted(own), n, m
        contained, children = set(), []
        for k, (_, low, _) in enumerate(more):
            nexts = []
            for j, (other, up, s) in enumerate(more[:k]):
                both = merged(up, low)
                if both is not None and (t := int(both[2].sum())) >= least:
                    nexts.append((other, both, t))
                    if t == s:
                        contained.add(j)  # whatever is closed and holds it holds the deeper item too
            children.append(nexts)
        for k, (item, low, s) in enumerate(more):
            if k not in contained:
                stack.append((own + [item], s, int(np.bitwise_xor.reduce(low[3])), children[k]))


def support_in(lists: dict[int, tuple[int, List]], items: list[int]) -> int:
    """Support of items together with the suffix of the class: merges from the deepest item up."""
    found = sorted((lists[i] for i in items), key=lambda x: -x[0])
    low: List | None = found[0][1]
    for _, up in found[1:]:
        low = merged(up, low) if low is not None else None
    return 0 if low is None else int(low[2].sum())


def _mine(least: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        whole = g["path"].map(len).to_numpy() == 0  # the row that stands for all baskets of the class
        node, g = g[whole].iloc[0], g[~whole]
        lists = n_lists(g["path"].tolist(), g["n"].to_numpy(), g["mark"].to_numpy())
        found = closed_sets(lists, least, node["class"].tolist(), int(node["n"]), int(node["mark"]))
        return pd.DataFrame(list(found), columns=["items", "n", "mark"])

    return run


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by class, its paths before the questions: questions are answered as they pass."""
    now, paths, lists = None, [], None
    for b in batches:
        out = []
        for key, rest, path, n, mark in zip(b["key"], b["rest"], b["path"], b["n"], b["mark"], strict=True):
            if key != now:
                now, paths, lists = key, [], None
            if rest is None:
                paths.append((path, n, mark))
                continue
            if lists is None:
                found = n_lists([p[0] for p in paths], np.array([p[1] for p in paths], np.int64), np.array([p[2] for p in paths], np.int64))
                lists, paths = {i: (k, x) for k, (i, x) in enumerate(found)}, []
            out.append((rest, support_in(lists, path.tolist())))
        yield pd.DataFrame(out, columns=["rest", "a"])


def classes_of(bases: DataFrame, least: int, long: int, spare: int) -> tuple[DataFrame, DataFrame]:
    """bases(class, path, n, mark) -> (nodes(class, n, mark) one item longer that are frequent, the bases of these).

    Only baskets of ``spare`` weight in all have paths of ``long`` items or more."""
    rows = stage(bases.withColumn("row", F.monotonically_increasing_id()), "basket-bases")
    nodes = rows.select("class", "n", "mark", F.explode("path").alias("item")).groupBy("class", "item").agg(F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"))
    nodes = nodes.where(F.col("n") >= least).select(F.concat("class", F.array("item")).alias("class"), "n", "mark")
    pair = ["class", "item", "upper"]
    each = rows.where(F.size("path") < long).select("row", "class", "n", "mark", "path", F.posexplode("path").alias("at", "item")).where("at > 0")
    short = each.select("row", "class", "n", "mark", "item", F.explode(F.slice("path", 1, F.col("at"))).alias("upper"))
    counts = short.groupBy(*pair).agg(F.sum("n").alias("n"))
    if not spare:
        pairs = stage(counts.where(F.col("n") >= least).select(*pair), "basket-pairs")
        kept = short.join(pairs, pair, "left_semi")
    else:
        near = stage(counts.where(F.col("n") >= least - spare), "basket-pairs")
        tall = rows.where(F.size("path") >= long).select("row", "class", "n", "mark", F.explode("path").alias("item"))
        met = tall.join(near.select(*pair), ["class", "item"]).join(tall.select("row", F.col("item").alias("upper")), ["row", "upper"])
        met = stage(met.select("row", "class", "n", "mark", "item", "upper"), "basket-met")
        pairs = near.select(*pair, "n").union(met.select(*pair, "n")).groupBy(*pair).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        pairs = stage(pairs.select(*pair), "basket-pairs")
        kept = short.join(pairs, pair, "left_semi").unionByName(met.join(pairs, pair, "left_semi"))
    paths = kept.groupBy("row", "class", "item").agg(F.sort_array(F.collect_list("upper")).alias("path"), F.first("n").alias("n"), F.first("mark").alias("mark"))
    paths = paths.groupBy(F.concat("class", F.array("item")).alias("class"), "path").agg(F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"))
    return nodes, stage(paths, "basket-bases")


def _longest(paths: DataFrame, least: int) -> tuple[int, int]:
    """(a size, the baskets of that size or more): the least power of two that at most half the least support reach."""
    found = paths.groupBy(F.floor(F.log2(F.size("path"))).alias("b")).agg(F.sum("n").alias("n")).collect()  # a row a power of two
    power = SHORT
    while sum(r.n for r in found if r.b >= power) > least // 2:
        power += 1
    return 1 << power, sum(r.n for r in found if r.b >= power)


def itemsets(lines: DataFrame, *, basket_col: str, item_col: str, least: int = LEAST, one_in: int = ONE_IN, confidence: int = CONFIDENCE, class_rows: int = CLASS_ROWS) -> DataFrame:
    """(items: array<long> ascending, support, rules: array<struct<c, a, s>> by c) of all closed itemsets that at least ``least`` and one in
    ``one_in`` baskets hold. A rule has at least ``confidence`` per cent and is better than chance."""
    rows = lines.select(F.col(basket_col).alias("basket"), F.col(item_col).cast("long").alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    baskets = rows.select("basket").distinct().count()
    least = max(least, -(-baskets // one_in))
    likely = stage(rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item"), "basket-likely")
    rows = stage(rows.join(likely, "item", "left_semi").distinct(), "basket-rows")
    mark = F.xxhash64("basket")
    items = stage(rows.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("mark")).where(F.col("n") >= least), "basket-items")
    whole = rows.join(items.select("item", "n"), "item").groupBy("basket").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "item"))).alias("r"))
    paths = whole.where(F.size("r") > 1).select(F.col("r.item").alias("path"), mark.alias("mark")).groupBy("path").agg(F.count("*").alias("n"), F.bit_xor("mark").alias("mark"))
    bases = stage(paths.select(F.array().cast("array<long>").alias("class"), "path", "n", "mark"), "basket-bases")
    long, spare = _longest(bases, least)

    _, bases = classes_of(bases, least, long, spare)
    nodes = items.select(F.array("item").alias("class"), "n", "mark")  # also of baskets of one item
    found, light, heavy, deeper = [], [], [], []
    while True:
        big = stage(bases.groupBy("class").agg(F.count("*").alias("k")).where(F.col("k") > class_rows).select("class"), "basket-big")
        ends = big.isEmpty()
        own = bases if ends else bases.join(big, "class", "left_anti")
        mined = own.select("class").distinct()
        with_rows = own.unionByName(nodes.join(mined, "class", "left_semi").select("class", F.array().cast("array<long>").alias("path"), "n", "mark"))
        found.append(with_rows.groupBy("class").applyInPandas(_mine(least), "items array<long>, n long, mark long"))
        alone = nodes.join(mined, "class", "left_anti")
        light.append(own)
        if ends:
            found.append(alone.select(F.array_sort("class").alias("items"), "n", "mark"))
            break
        found.append(alone.join(big, "class", "left_anti").select(F.array_sort("class").alias("items"), "n", "mark"))
        split = nodes.join(big, "class", "left_semi")
        nodes, bases = classes_of(bases.join(big, "class", "left_semi"), least, long, spare)
        nodes = stage(nodes, "basket-nodes")
        last = nodes.select(F.slice("class", 1, F.size("class") - 1).alias("class"), F.element_at("class", -1).alias("item"), "n")
        all_of = split.join(last, ["class", "n"], "left").groupBy("class", "n", "mark").agg(F.collect_list("item").alias("more"))
        found.append(all_of.select(F.array_sort(F.concat("class", "more")).alias("items"), "n", "mark"))
        heavy.append(big)
        deeper.append(nodes)
    sets = stage(reduce(DataFrame.unionByName, found), "basket-found")
    most = sets.groupBy("n", "mark").agg(F.max_by("items", F.struct(F.size("items"), "items")).alias("most"))
    outside = (F.col("items") == F.col("most")) | (F.size(F.array_except("items", "most")) > 0)
    closed = stage(sets.join(most, ["n", "mark"]).where(outside).select("items", F.col("n").alias("support")).distinct(), "basket-closed")
    return _with_rules(closed, items, light, heavy, deeper, baskets, confidence)


def _with_rules(closed: DataFrame, items: DataFrame, light: list[DataFrame], heavy: list[DataFrame], deeper: list[DataFrame], baskets: int, confidence: int) -> DataFrame:
    each = closed.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("item")).join(items.select("item", "n"), "item")
    each = each.groupBy("items", "support").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("item").alias("c")))).alias("r"))
    each = each.select("items", "support", "r", F.posexplode("r").alias("at", "x"))
    each = each.select("items", "support", F.col("x.c").alias("c"), (-F.col("x.o")).alias("s"), F.filter("r", lambda y: y["c"] != F.col("x.c")).alias("others"))
    each = each.select("items", "support", "c", "s", F.array_sort(F.col("others.c")).alias("rest"), F.element_at("others", -1).alias("last"))
    each = stage(each, "basket-each")
    asked = each.where(F.size("rest") > 1).select("rest", F.array("last.c").alias("class"), F.array_remove("rest", F.col("last.c")).alias("path")).distinct()
    known = [each.where(F.size("rest") == 1).select("rest", (-F.col("last.o")).alias("a")).distinct()]
    for level, own in enumerate(light):
        here = asked
        if level < len(heavy):
            asked = stage(asked, "basket-asked")
            here = asked.join(heavy[level], "class", "left_anti")
            asked = asked.join(heavy[level], "class", "left_semi").select("rest", F.concat("class", F.array(F.array_max("path"))).alias("class"), F.array_remove("path", F.array_max("path")).alias("path"))
            known.append(asked.where(F.size("path") == 0).join(deeper[level], "class").select("rest", F.col("n").alias("a")))
            asked = asked.where(F.size("path") > 0)
        here = stage(here, "basket-asked")
        none = F.lit(None).cast("array<long>")
        both = own.join(here.select("class").distinct(), "class", "left_semi").select("class", none.alias("rest"), "path", "n", "mark")
        both = both.unionByName(here.select("class", "rest", "path", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("mark")))
        parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = both.withColumn("key", F.array_join("class", ",")).repartition(parts, "key").sortWithinPartitions("key", F.col("rest").isNotNull())
        known.append(ordered.select("key", "rest", "path", "n", "mark").mapInPandas(_answer, "rest array<long>, a long"))
    a = stage(reduce(DataFrame.unionByName, known), "basket-supports")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rules = each.join(a, "rest").where((100 * F.col("support") >= confidence * F.col("a")) & (wide("support") * F.lit(baskets).cast("decimal(19,0)") > wide("a") * wide("s")))
    rules = rules.groupBy(F.col("items").alias("of")).agg(F.sort_array(F.collect_list(F.struct("c", "a", "s"))).alias("rules"))
    none = F.array().cast("array<struct<c: bigint, a: bigint, s: bigint>>")
    return closed.join(rules, F.col("items") == F.col("of"), "left").select("items", "support", F.coalesce("rules", none).alias("rules"))


def itemset_report(lines: DataFrame, *, basket_col: str = "sale_id", item_col: str = "item_id", **parameters: int) -> DataFrame:
    found = itemsets(lines, basket_col=basket_col, item_col=item_col, **parameters)
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"], r["c"].alias("c"))))
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    return found.select(
        F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"),
        best["c"].alias("best_item"), F.sha2(text, 256).alias("rules_sha256"),
    )


#: All frequent itemsets, basket by basket and item by item; those without an equal superset; their rules.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT DISTINCT sale_id AS s, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
b AS (SELECT count(DISTINCT s) AS n, greatest(5, (count(DISTINCT s) + 19999) // 20000) AS least FROM d),
f AS (SELECT i, count(*) AS n FROM d GROUP BY i HAVING count(*) >= (SELECT least FROM b)),
o AS (SELECT d.s, d.i, f.n FROM d JOIN f ON d.i = f.i),
g(items, top, s, n) AS (
  SELECT [i], i, s, n FROM o
  UNION ALL
  SELECT items, top, s, n FROM (
    SELECT list_append(g.items, o.i) AS items, o.i AS top, g.s AS s, count(*) OVER (PARTITION BY g.items, o.i) AS n
    FROM g JOIN o ON o.s = g.s AND o.i > g.top) WHERE n >= (SELECT least FROM b)),
q AS (SELECT items, count(*) AS n FROM g GROUP BY items),
e AS (SELECT items, n, c, list_filter(items, lambda x: x <> c) AS rest FROM (SELECT items, n, unnest(items) AS c FROM q WHERE len(items) > 1)),
k AS (SELECT q.items, q.n FROM q ANTI JOIN e ON e.rest = q.items AND e.n = q.n),
r AS (SELECT e.items, e.c, a.n AS a, f.n AS s FROM e JOIN k ON k.items = e.items JOIN q AS a ON a.items = e.rest JOIN f ON f.i = e.c
      WHERE 100 * e.n >= 60 * a.n AND e.n * (SELECT n FROM b) > a.n * f.n),
t AS (SELECT items, count(*) AS n_rules, arg_min(c, {'a': a, 'c': c}) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS x FROM r GROUP BY items)
SELECT array_to_string(k.items, ',') AS items, CAST(len(k.items) AS BIGINT) AS n_items, k.n AS support, coalesce(t.n_rules, 0) AS n_rules, t.best_item, sha256(coalesce(t.x, '')) AS rules_sha256
FROM k LEFT JOIN t ON t.items = k.items
"""
