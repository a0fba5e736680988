"""Sharding by histogram sort.

Rows are ordered by (60-bit hash of the text, 60-bit hash of the id). Splitters are found
by probing: each round cuts every open cell of the key space into ``FAN`` equal intervals,
counts exact bytes and rows below each of them across all partitions, and keeps the
interval that holds the splitter, until its bytes are within tolerance of the aim. Between splitters
keys are hashes, so equal slices of the key space hold about equal bytes: a range is sliced until a slice
holds about ``slice_bytes``. Rows are then exchanged once, by range and slice, and numbered
inside it; the rows of each slice are counted, so numbers are gapless over a whole shard.

Equal texts are neighbours in this order, and a splitter falls between two texts wherever
that meets the tolerance; a group of copies larger than that is cut by id hash, so no shard
and no task ever has to hold a whole group. What reaches the driver is at most
``ranges * FAN`` counts a round, whatever the input's size.

Law: ``bytes`` - shards hold nearly equal bytes (UTF-8 bytes of the text plus 1 a row).

Defined results
    null text: no bytes, checksum 0, size 1. Empty text: the same. Null id: hashed as the empty
    string. Repeated rows (same id and text): kept together, never dropped. Empty table: an
    empty result. Input columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileflow.llm.mixing import id_hash
from tileflow.llm.scratch import stage

FAN = 256
TOP = (1 << 60) - 1


@dataclass(frozen=True)
class Cell:
    """An interval of the key space: of text hashes (k is None), or of id hashes within text hash k."""

    k: int | None
    lo: int
    hi: int

    @property
    def width(self) -> int:
        return -(-(self.hi - self.lo + 1) // FAN)

    def holds(self) -> Column:
        if self.k is None:
            return F.col("k").between(self.lo, self.hi)
        return (F.col("k") == self.k) & F.col("h").between(self.lo, self.hi)

    def bucket(self) -> Column:
        return F.floor((F.col("k" if self.k is None else "h") - self.lo) / F.lit(self.width)) if self.width >= 1 << 52 else F.expr(f"({'k' if self.k is None else 'h'} - {self.lo}L) div {self.width}L")

    def part(self, b: int) -> Cell:
        return Cell(self.k, self.lo + b * self.width, min(self.hi, self.lo + (b + 1) * self.width - 1))

    def start(self) -> tuple[int, int]:
        return (self.lo, 0) if self.k is None else (self.k, self.lo)

    def after(self) -> tuple[int, int]:
        if self.k is None:
            return (self.hi + 1, 0)
        return (self.k, self.hi + 1)

    def inner(self) -> Cell | None:
        """The next finer cell once this one is a single value."""
        return Cell(self.lo, 0, TOP) if self.k is None else None


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    return docs.select(*keep, size.alias("size"), id_hash(F.col(text_col)).alias("k"), id_hash(F.col(id_col)).alias("h"))


def splitters(rows: DataFrame, ranges: int, slack: list[float]) -> list[tuple[int, int]]:
    """rows(k, h, size), staged -> the first keys of ranges 1..
    slack: for each splitter, the bytes by which it may miss its aim."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    aims = [total * i // ranges for i in range(1, ranges)]
    found: dict[int, tuple[int, int]] = {}
    cells = {i: (Cell(None, 0, TOP), 0) for i in range(len(aims))} if total else {}
    while cells:
        open_cells = sorted({c for c, _ in cells.values()}, key=lambda c: (c.start(), c.k is not None))
        number = {c: n for n, c in enumerate(open_cells)}
        which, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for c, n in number.items():
            which, bucket = F.when(c.holds(), F.lit(n)).otherwise(which), F.when(c.holds(), c.bucket()).otherwise(bucket)
        counted = rows.select(which.alias("c"), bucket.alias("b"), "size").where("c is not null").groupBy("c", "b").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        by: dict[int, list] = {}
        for r in counted.collect():
            by.setdefault(r.c, []).append((r.b, r.bytes, r.rows))
        nxt = {}
        for i, (cell, under) in cells.items():
            aim = aims[i]
            for b, n_bytes, n_rows in sorted(by[number[cell]]):
                if under + n_bytes >= aim:
                    break
                under += n_bytes
            part = cell.part(b)
            if aim - under <= slack[i]:
                found[i] = part.start()
            elif under + n_bytes - aim <= slack[i]:
                found[i] = part.after()
            elif part.lo < part.hi and n_rows > 1:
                nxt[i] = (part, under)
            elif n_rows > 1 and (inner := part.inner()):
                nxt[i] = (inner, under)
            else:
                near = aim - under <= under + n_bytes - aim
                found[i] = part.start() if near else part.after()
        cells = nxt
    return [found[i] for i in sorted(found)]


def range_of(keys: list[tuple[int, int]], first: int = 0) -> Column:
    """Number of splitters at or below the row's key, as a balanced tree of comparisons."""
    if not keys:
        return F.lit(first)
    mid = len(keys) // 2
    k, h = keys[mid]
    at_or_above = (F.col("k") > k) | ((F.col("k") == k) & (F.col("h") >= h))
    return F.when(at_or_above, range_of(keys[mid + 1 :], first + mid + 1)).otherwise(range_of(keys[:mid], first))


def slice_of(keys: list[tuple[int, int]], slices: int) -> Column:
    """Slice of a row within its range, rising with the key: of the id hash in the text a range begins in, then of the text hash, then of the
    id hash in the text it ends in. So a text with very many rows is cut wherever the edges of ranges fall in it."""
    edges = [(0, 0), *keys, (TOP + 1, 0)]
    pairs = list(zip(edges, edges[1:], strict=False))
    of = lambda values, kind="long": F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("range_no") + 1)
    part = lambda value, width: F.least(F.floor(value / of([max(w, 1) for w in width], "double") * slices), F.lit(slices - 1))
    first, last = of([k for (k, _), _ in pairs]), of([k2 if k2 <= TOP else -1 for _, (k2, _) in pairs])
    begins = part(F.col("h") - of([h for (_, h), _ in pairs]), [(h2 if k == k2 else TOP + 1) - h for (k, h), (k2, h2) in pairs])
    between = part(F.col("k") - first, [k2 - k for (k, _), (k2, _) in pairs])
    ends = part(F.col("h"), [h2 for _, (_, h2) in pairs])
    return F.when(F.col("k") == first, begins).when(F.col("k") == last, ends + 2 * slices).otherwise(between + slices).cast("int")


def shard(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, tolerance: float = 0.002, ranges_per_shard: int = 8, slice_bytes: int = 128 << 20) -> DataFrame:
    """``keep`` (all columns as struct ``doc`` by default), size, shard, slot. Splitters of shards
    miss their aim by at most ``tolerance`` of a shard, unless one row is larger than that."""
    rows = stage(keyed(docs, id_col, text_col, keep if keep is not None else [F.struct("*").alias("doc")]), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * ranges_per_shard
    # only splitters between shards must be near their aim; the others just spread the work
    slack = [total / shards * (0.2 / ranges_per_shard if i % ranges_per_shard else tolerance) for i in range(1, ranges)]
    keys = splitters(rows, ranges, slack)
    placed = rows.withColumn("range_no", range_of(keys).cast("int"))
    placed = placed.withColumn("slice_no", slice_of(keys, max(1, -(-total // (ranges * slice_bytes)))))
    dealt = ["range_no", "slice_no"]
    count = placed.groupBy(*dealt).agg(F.count("*").alias("n")).withColumn("shard", F.floor(F.col("range_no") / ranges_per_shard).cast("int"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(*dealt)) - F.col("n")
    count = stage(count.select(*dealt, "shard", before.alias("before")), "shard-counts")
    slot = F.row_number().over(Window.partitionBy(*dealt).orderBy("k", "h")) - 1 + F.col("before")
    return placed.join(count, dealt).withColumn("slot", slot.cast("long")).drop("k", "h", "before", *dealt)


def shard_report(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    keep = [F.col(id_col).alias("id"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32")]
    out = shard(docs, shards, id_col=id_col, text_col=text_col, keep=keep)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
