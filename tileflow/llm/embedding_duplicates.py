"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected to ``BLOCKS`` times 8 dimensions by a random Gaussian matrix, one for each of
``TABLES`` tables, scaled, and each 8 coordinates are decoded to the nearest point of the lattice E8; the
points together are the vector's cell. A vector also probes ``PROBES`` neighbouring cells, those that a shift
by a shortest lattice vector in one or more blocks reaches at the least distance, so two vectors meet in a
table if one lies in the other's cell or in a cell the other probes. At cosine 0.95 they meet in one table
with probability 0.45, and miss each other in all of them once in 4,000; closer pairs far less. Of unrelated
pairs one in 5,000 meets.

Equal vectors are one node with a count, so copies are never compared. The members of a cell are compared in
blocks of bounded size, a group for each pair of blocks: first by ``BITS`` random-projection signs each, which
leaves members without a possible partner behind, so that vectors travel only to cells in which they
probably link; then by exact cosine in double precision. A task gives each node one row: how many vectors it
links to, and a node of its connected part. Pairs are not emitted. A pair that meets in several cells counts only
where it meets first, which both vectors' hashes tell.

Defined results
    null vector, zero vector, null or non-finite component, empty vector: no links, a component of its own.
    Null id: its vector takes no part; no links, null component, not kept. Repeated rows: linked
    copies. Vectors of different lengths are never linked. Labels are not read. Empty table: an
    empty result. Ties: a component is named by its smallest id; rows that share it are all kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.components import components
from tileflow.llm.groups import together
from tileflow.llm.scratch import stage

THRESHOLD = 0.95
#: Parameters of the hash. More tables find more, more blocks or a larger scale compare less, more probes need fewer tables.
TABLES, PROBES, BLOCKS, SCALE = 14, 4, 2, 0.6
#: Signs of a vector, and how many may differ. Of a pair at cosine 0.95 13 differ on average, more than 40 once in 10^10; of an unrelated pair 64.
BITS, MOST_DIFFERENT = 128, 40
#: Members of a cell that are compared at once with as many others.
BLOCK = 1024
#: Rows of a group up to which its pairs are formed together with those of other groups.
SMALL = 64


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(c < 0 for c in x) % 2 == 0]
    return np.array([*whole, *half], float)


#: All have the squared length 2.
ROOTS = _roots()
#: One of each pair r, -r.
HALF = np.array([r for r in ROOTS if tuple(r) > tuple(-r)])
#: Coordinates of lattice points are halves; doubled they are integers, hashed by odd numbers.
CODE = np.random.default_rng(8).integers(1, 1 << 62, (BLOCKS, 8), dtype=np.int64) * 2 + 1
TABLE_CODE = np.int64(0x2127599BF4325C37)
#: What a shift by a root adds to a code.
SHIFT = [np.rint(HALF * 2).astype(np.int64) @ c for c in CODE]


@cache
def projection(dim: int, tables: int = TABLES) -> np.ndarray:
    return np.random.default_rng(1234).standard_normal((tables, dim, 8 * BLOCKS)) * SCALE


@cache
def _sides(dim: int) -> np.ndarray:
    return np.random.default_rng(4321).standard_normal((dim, BITS))


def signs(x: np.ndarray) -> np.ndarray:
    """BITS signs of random projections, as longs."""
    return np.packbits(x @ _sides(x.shape[1]) > 0, axis=1).view(np.int64)


def _even_point(x: np.ndarray) -> np.ndarray:
    """Nearest integer point of even coordinate sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)[:, None]
    step = np.where(np.take_along_axis(off, worst, 1) >= 0, 1.0, -1.0)
    odd = near.sum(axis=1) % 2 != 0
    fixed = near.copy()
    np.put_along_axis(fixed, worst, np.take_along_axis(near, worst, 1) + step, 1)
    return np.where(odd[:, None], fixed, near)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of the even points and their shift by one half."""
    a, b = _even_point(x), _even_point(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _nearest(costs: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n least of each row."""
    return np.argpartition(costs, n - 1, axis=1)[:, :n] if n < costs.shape[1] else np.tile(np.arange(costs.shape[1]), (len(costs), 1))


def cells(x: np.ndarray) -> np.ndarray:
    """Unit vectors -> codes (rows, tables, 1 + PROBES) of the own cell and of those probed."""
    out = np.empty((len(x), TABLES, 1 + PROBES), np.int64)
    none = np.zeros((len(x), 1))
    for t, p in enumerate(projection(x.shape[1])):
        y = x @ p
        own, cost, shift = np.full(len(x), x.shape[1] * TABLES + t, np.int64) * TABLE_CODE, none, none.astype(np.int64)
        for block, (code, shifts) in enumerate(zip(CODE, SHIFT, strict=True)):
            z = y[:, 8 * block : 8 * block + 8]
            c = decode(z)
            own += np.rint(c * 2).astype(np.int64) @ code
            # a shift by a root r changes the squared distance by r.r - 2 (z - c).r, so by its sign r or -r is the nearer
            along = (z - c) @ HALF.T
            near = _nearest(-np.abs(along), PROBES)
            along = np.take_along_axis(along, near, 1)
            here, moved = np.hstack([none, 1 - np.abs(along)]), np.hstack([none.astype(np.int64), np.where(along < 0, -1, 1) * shifts[near]])
            cost, shift = (cost[:, :, None] + here[:, None, :]).reshape(len(x), -1), (shift[:, :, None] + moved[:, None, :]).reshape(len(x), -1)
            near = _nearest(cost[:, 1:], PROBES) + 1  # the first is the own cell
            near = np.hstack([none.astype(np.int64), near])
            cost, shift = np.take_along_axis(cost, near, 1), np.take_along_axis(shift, near, 1)
        out[:, t] = own[:, None] + shift
    return out


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cells of paired vectors -> the cell that counts them, of the first table in which they meet."""
    same = a[:, :, 0] == b[:, :, 0]
    a_in = (b[:, :, 1:] == a[:, :, :1]).any(axis=2)
    b_in = (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
    first = (same | a_in | b_in).argmax(axis=1)
    at = np.arange(len(a)), first
    ca, cb = a[:, :, 0][at], b[:, :, 0][at]
    return np.where(same[at] | a_in[at] & ~b_in[at], ca, np.where(b_in[at] & ~a_in[at], cb, np.minimum(ca, cb)))


Test = Callable[[np.ndarray, np.ndarray, bool], np.ndarray]


def pairs(g: pd.DataFrame, group: np.ndarray, test: Test) -> tuple[np.ndarray, np.ndarray]:
    """Rows of groups (cell, i, j) -> positions of the pairs that pass the test: one of them lies in the cell, each pair once.

    ``test(a, b, crossed)`` tells of rows a and b, either one by one or, crossed, all a with all b. Small groups are paired
    all at once, by the distance of their rows; of a larger one, block i meets block j."""
    own, block, i, j = (g[c].to_numpy() for c in ("own", "block", "i", "j"))
    size = np.bincount(group)[group]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, SMALL):
        a = np.flatnonzero((group[:-d] == group[d:]) & (size[d:] <= SMALL))
        if not len(a):
            break
        a = a[(own[a] | own[a + d]) & ((i[a] == j[a]) | (block[a] != block[a + d]))]
        a = a[test(a, a + d, False)]
        left.append(a)
        right.append(a + d)
    for first in np.flatnonzero((size > SMALL) & (group != np.concatenate([[-1], group[:-1]]))):
        rows = np.arange(first, first + size[first])
        a, b = rows[block[rows] == i[first]], rows[block[rows] == j[first]]
        may = own[a][:, None] | own[b][None, :]
        if i[first] == j[first]:
            may = np.triu(may, 1)
        x, y = np.nonzero(may & test(a, b, True)) if may.any() else ([], [])
        left.append(a[x])
        right.append(b[y])
    return np.concatenate(left), np.concatenate(right)


def possible(g: pd.DataFrame, group: np.ndarray) -> pd.DataFrame | None:
    """The members of groups whose signs leave them a partner."""
    signs = [g[c].to_numpy().view(np.uint64) for c in ("s0", "s1")]

    def test(a: np.ndarray, b: np.ndarray, crossed: bool) -> np.ndarray:
        a = a[:, None] if crossed else a
        return sum(np.bitwise_count(s[a] ^ s[b]).astype(np.uint8) for s in signs) <= MOST_DIFFERENT

    live = np.unique(np.concatenate(pairs(g, group, test)))
    return g.loc[live, ["cell", "i", "j", "block", "own", "node"]] if len(live) else None


def compared(g: pd.DataFrame, group: np.ndarray, least: float) -> pd.DataFrame | None:
    """Rows of groups -> (node, links, root) of their linked nodes."""
    out = [one for _, at in g.groupby(g["v"].map(len)).indices.items() if (one := _compared(g.iloc[at], group[at], least)) is not None]
    return pd.concat(out, ignore_index=True) if out else None


def _compared(g: pd.DataFrame, group: np.ndarray, least: float) -> pd.DataFrame | None:
    x = _unit(g["v"])
    a, b = pairs(g, group, lambda a, b, crossed: (x[a] @ x[b].T if crossed else (x[a] * x[b]).sum(axis=1)) >= least)
    if not len(a):
        return None
    node, cell, n = (g[c].to_numpy() for c in ("node", "cell", "n"))
    _, first, same = np.unique(node, return_index=True, return_inverse=True)  # a vector is in several cells of a batch
    linked, at = np.unique(same[np.concatenate([a, b])], return_inverse=True)
    h = cells(x[first[linked]])
    ha, hb = at[: len(a)], at[len(a) :]
    links = np.zeros(len(g), np.int64)
    for s in range(0, len(a), 200_000):
        pa, pb = a[s : s + 200_000], b[s : s + 200_000]
        mine = _met(h[ha[s : s + 200_000]], h[hb[s : s + 200_000]]) == cell[pa]
        np.add.at(links, pa[mine], n[pb[mine]])
        np.add.at(links, pb[mine], n[pa[mine]])
    root = np.arange(len(g))
    while True:
        nxt = root.copy()
        np.minimum.at(nxt, a, root[b])
        np.minimum.at(nxt, b, root[a])
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    who = np.unique(np.concatenate([a, b]))
    return pd.DataFrame({"node": node[who], "links": links[who], "root": node[root[who]]})


def links(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """vectors(node, v, n), distinct and staged -> (node, links, root), rows to be added up by node."""
    spark = vectors.sparkSession

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.tile(np.arange(1 + PROBES) == 0, TABLES)
        for b in batches:
            for _, g in b.groupby(b["v"].map(len)):
                h = cells(_unit(g["v"]))
                yield pd.DataFrame({"cell": h.reshape(-1), "node": np.repeat(g["node"].to_numpy(), len(own)), "own": np.tile(own, len(g))})

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(b["v"].map(len)):
                s = signs(_unit(g["v"]))
                yield pd.DataFrame({"signed": g["node"].to_numpy(), "s0": s[:, 0], "s1": s[:, 1]})

    rows = stage(vectors.select("node", "v").mapInPandas(hashed, "cell long, node long, own boolean"), "lattice-cells")
    # a cell of one member, or of none that lies in it, has no pair
    size = rows.groupBy("cell").agg(F.count("*").alias("m"), F.count_if("own").alias("owners")).where("m > 1 AND owners > 0").drop("owners")
    size = stage(size, "lattice-sizes")  # else a join with an aggregate, which can't be split at a crowded cell
    member = rows.join(size, "cell").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "node")
    by, parts = ["cell", "i", "j"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, *by).sortWithinPartitions(*by)
    sign = vectors.select("node", "v").mapInPandas(signed, "signed long, s0 long, s1 long")
    live = dealt(member.join(sign, F.col("node") == F.col("signed")).drop("signed")).mapInPandas(together(by, possible, [*by, "block", "own", "node"]), "cell long, i int, j int, block int, own boolean, node long")
    full = dealt(stage(live, "lattice-live").join(vectors, "node"))
    return full.mapInPandas(together(by, lambda g, group: compared(g, group, least), ["node", "links", "root"]), "node long, links long, root long")


def embedding_report(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    good = F.col("id").isNotNull() & F.expr("coalesce(size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0), false)")
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("good", good)
    rows = rows.withColumn("fp", F.when(F.col("good"), F.unhex(F.md5(F.col("v").cast("string")))))
    nodes = rows.where("good").groupBy("fp").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least_id"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")  # the number is fixed once staged
    found = stage(links(nodes.select("node", "v", "n"), least).groupBy("node", "root").agg(F.sum("links").alias("links")), "lattice-links")
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "part_node")
    counted = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "linked")
    node = nodes.select("fp", "node", "n", "least_id").join(parts, F.col("node") == F.col("part_node"), "left").join(counted, F.col("node") == F.col("linked"), "left")
    node = stage(node.select("fp", "n", "least_id", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "lattice-nodes")
    name = stage(node.groupBy("component").agg(F.min("least_id").alias("component_id")), "lattice-names")
    node = node.join(name, "component").select(F.col("fp").alias("f"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "fp").join(node, F.col("fp") == F.col("f"), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
