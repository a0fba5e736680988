"""Packing documents into fixed-length sequences by hierarchical residual packing.

Documents are tokenised, ended with one id, and cut only where they are longer than a
sequence. Pieces are dealt by a hash of their row number to leaves of about ``LEAF``, so that each
sees the whole mix of lengths whatever the input's order, and packed there by best fit, largest first. Bins with at
most ``SLACK`` free places are finished; all others go up a tree, where they are items of the next round
of best fit, dealt anew to nodes of about ``NODE`` bins, until one node holds all or a round joins no bin, or less than
one bin in ``stall``. A bin moves as a whole, so its pieces stay together and a round ships only what can still
be improved. A node holds at most ``CHUNK`` pieces or about ``NODE`` bins, whatever the input's size.

Best fit runs on residual classes: open bins are kept by free places, and a bit set of the
non-empty classes gives the tightest one, so an item costs a few machine operations.

Defined results
    null or empty text: the end id alone, one piece of length 1. Null id and repeated rows: every row
    is packed as a document of its own. Ties: items of one length go by their row number in the
    staged table, so a rerun of a task gives the same bins. Empty table: an empty result.
    A text of one more token than fits: a first piece of 1 and one full piece.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.arrow import computed
from tileflow.llm.scratch import stage

LENGTH = 1024
END_ID = 2
SLACK = 4
#: Bins of a node of the tree; a round that joins fewer than one bin in STALL (0: none at all) is the last.
NODE, STALL = 65_536, 200
CHUNK, LEAF = 400_000, 100_000
PROBE = "It's a test: café 你好  \t\n\n 12345 foo_bar <|endoftext|> don't x \U0001f600"


@cache
def encoder(path: str):
    """text -> ids of the tokenizer file at ``path``.

    A byte-level file is run by tiktoken from the same vocabulary, which gives the same ids at
    several times the speed; this is checked on a probe text, and any other file, or one that
    differs, is run by tokenizers itself. Special tokens in a text are ordinary text.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        return plain
    import public_tokenizers
    import tiktoken

    # fixed values: the byte alphabet of byte-level files maps printable bytes to themselves, others upwards from 256
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in kept)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if fast(PROBE) != plain(PROBE):
        return plain

    def encode(text: str) -> list[int]:
        try:
            return fast(text)
        except BaseException as e:  # its regex engine gives up on very long runs of white space
            if type(e).__name__ != "PanicException":
                raise
            return plain(text)

    return encode


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all full but the first."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids: little-endian uint32]) of every document."""

    def make():
        encode = encoder(tokenizer)

        def each(texts: list) -> list:
            at, rows, raw = [], [], []
            for i, text in enumerate(texts):
                ids = np.array([*encode(text), end_id] if text else [end_id], "<u4")
                for k, (s, n) in enumerate(cuts(len(ids), length)):
                    part = ids[s : s + n].tobytes()
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(part)))
                    if with_ids:
                        raw.append(part)
            return [at, *zip(*rows, strict=True), *([raw] if with_ids else [])]

        return each

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return computed(rows, ["text"], make, "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids, repeat=True)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; items are taken in the order given, each into the open bin it fits tightest."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    classes = n_bins = 0
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = classes >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                classes ^= 1 << room
        else:
            room, b, n_bins = capacity, n_bins, n_bins + 1
        out[i] = b
        if room := room - s:
            if not free[room]:
                classes |= 1 << room
            free[room].append(b)
    return out


def merge(bins: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, length: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One node: pieces of whole bins -> for each piece its bin after the round, its offset there, and whether that bin is done."""
    ids, of = np.unique(bins, return_inverse=True)
    used = np.bincount(of, weights=lengths).astype(np.int64)
    order = np.lexsort((ids, -used))
    into = best_fit(used[order], length)
    n = into.max() + 1
    opened = np.full(n, len(order))
    np.minimum.at(opened, into, np.arange(len(order)))
    first = order[opened]  # the item that opened a bin names it
    by_bin = np.lexsort((np.arange(len(order)), into))
    sizes = used[order][by_bin]
    before = np.cumsum(sizes) - sizes
    starts = np.searchsorted(into[by_bin], np.arange(n))
    shift, target = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    shift[order[by_bin]] = before - before[starts][into[by_bin]]
    target[order] = into
    room = length - np.bincount(into, weights=used[order], minlength=n).astype(np.int64)
    done = room <= slack
    return ids[first[target[of]]], offsets + shift[of], done[target[of]]


def _with(rows, name: str, values: np.ndarray):
    at = rows.schema.get_field_index(name)
    return rows.set_column(at, rows.schema.field(at), pa.array(values))


def _merged(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """One node over Arrow rows; ids pass through untouched."""
    bins, offsets, done = merge(*[rows.column(c).to_numpy() for c in ("bin", "length", "offset")], length, SLACK)
    for name, values in (("bin", bins), ("offset", offsets), ("done", done)):
        rows = _with(rows, name, values)
    yield from rows.combine_chunks().to_batches(max_chunksize=10_000)


def packed(parts: DataFrame, length: int = LENGTH, stall: int = STALL) -> DataFrame:
    """Pieces -> the same with sequence_id and offset. Every level is staged, so a lost executor repeats one level's tasks."""
    items = stage(parts, "pack-pieces").withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    items = items.withColumn("done", F.lit(False))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            full = pc.equal(b.column("length"), length)
            whole = b.filter(full)
            yield _with(whole, "done", np.ones(whole.num_rows, bool))
            held.append(b.filter(pc.invert(full)))
            if sum(x.num_rows for x in held) >= CHUNK:
                yield from _merged(pa.Table.from_batches(held), length)
                held = []
        if sum(x.num_rows for x in held):
            yield from _merged(pa.Table.from_batches(held), length)

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(x.num_rows for x in held):
            yield from _merged(pa.Table.from_batches(held), length)

    leaves = max(1, -(-items.count() // LEAF))
    level = stage(items.repartition(leaves, "bin").mapInArrow(leaf, items.schema), "pack-level")
    finished, turn, last = [level.where("done")], 0, None
    while left := level.where("NOT done").select("bin").distinct().count():
        if last is not None and (last[0] == 1 or left >= last[1] - (last[1] // stall if stall else 0)):
            finished.append(level.where("NOT done"))  # they can't be joined, or hardly
            break
        last, turn = (-(-left // NODE), left), turn + 1
        level = stage(level.where("NOT done").repartition(last[0], F.xxhash64("bin", F.lit(turn))).mapInArrow(node, items.schema), "pack-level")
        finished.append(level.where("done"))
    return reduce(DataFrame.unionAll, finished).withColumnRenamed("bin", "sequence_id").drop("done")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packing_report(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = packed(pieces(docs, tokenizer or default_tokenizer(), id_col=id_col, text_col=text_col))
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids: array<int>, doc_ids, offsets): the packed sequences themselves, at most ``length`` ids each."""
    parts = stage(pieces(docs, tokenizer or default_tokenizer(), id_col=id_col, text_col=text_col, length=length, with_ids=True), "pack-ids")
    where = packed(parts.drop("ids"), length).select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), "ids_crc32", "length", "sequence_id", "offset")
    # rows of one id, piece and checksum are the same ids, so numbering both sides pairs them without loss
    number = lambda df, d, p: df.withColumn("twin", F.expr(f"row_number() OVER (PARTITION BY {d}, {p}, ids_crc32, length ORDER BY ids_crc32)"))
    both = number(parts, "doc_id", "piece").alias("a").join(number(where, "d", "p").alias("b"), F.expr("a.doc_id <=> b.d AND a.piece = b.p AND a.ids_crc32 = b.ids_crc32 AND a.length = b.length AND a.twin = b.twin"))
    schema = f"sequence_id long, ids array<int>, doc_ids array<{docs.schema[id_col].dataType.simpleString()}>, offsets array<long>"

    def assemble(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("offset")
        ids = np.frombuffer(b"".join(g["ids"]), "<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": [g["sequence_id"].iloc[0]], "ids": [ids], "doc_ids": [g["doc_id"].tolist()], "offsets": [g["offset"].tolist()]})

    return both.select("b.sequence_id", "b.offset", "a.doc_id", "a.ids").groupBy("sequence_id").applyInPandas(assemble, schema)
