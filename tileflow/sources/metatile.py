"""The metatile container: 20 header bytes, 64 (offset, size) entries, then the tiles.

The index is read by SQL expressions, so statistics and integrity checks never leave the
JVM; packing 64 tiles into one value uses an Arrow-batched function.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.constants import MAX_SIZE, META_HEADER, METATILE
from tileflow.functions.address import metatile_slot
from tileflow.sources.wire import read_int32

SLOTS = METATILE * METATILE
HEAD = struct.Struct("<4siiii")
ENTRY = struct.Struct("<ii")


def pack(x: int, y: int, z: int, tiles: dict[int, bytes], compressed: bool = False) -> bytes:
    """Slot -> tile; slots without one have size 0."""
    index, body, at = [], [], META_HEADER
    for slot in range(SLOTS):
        data = tiles.get(slot) or b""
        if compressed and data:
            data = gzip.compress(data, mtime=0)
        index.append(ENTRY.pack(at, len(data)))
        body.append(data)
        at += len(data)
    return HEAD.pack(b"METZ" if compressed else b"META", SLOTS, x, y, z) + b"".join(index) + b"".join(body)


def locate(head: bytes, length: int, slot: int) -> tuple[int, int]:
    """(offset, size) of a slot by the first bytes of a container of some length; size is a negative code if something is wrong."""
    if len(head) < HEAD.size:
        return 0, -2 if not head else -3
    magic, count, *_ = HEAD.unpack_from(head)
    if magic not in (b"META", b"METZ"):
        return 0, -4
    if count != SLOTS:
        return 0, -5
    if len(head) < META_HEADER:
        return 0, -3
    at, size = ENTRY.unpack_from(head, HEAD.size + ENTRY.size * slot)
    if size > MAX_SIZE:
        return 0, -6
    if at < 0 or at > length:
        return 0, -7
    if at + size > length:
        return 0, -8
    return at, size


def unpack(blob: bytes, x: int, y: int) -> tuple[int, bytes | None, bool]:
    """(bytes read or a negative code, tile as stored, compressed)."""
    at, size = locate(blob[:META_HEADER], len(blob), (x & 7) * METATILE + (y & 7))
    return (size, blob[at : at + size], blob[:4] == b"METZ") if size >= 0 else (size, None, False)


def read_status(blob: Column, slot: Column) -> Column:
    """The size of the tile in a slot, or the negative code of what is wrong with the file (null blob: -1)."""
    magic = F.substring(blob, 1, 4).cast("string")
    at, size = entry(blob, slot)
    return (
        F.when(blob.isNull(), -1).when(F.length(blob) == 0, -2).when(F.length(blob) < HEAD.size, -3).when(~magic.isin("META", "METZ"), -4).when(read_int32(blob, 4) != SLOTS, -5)
        .when(F.length(blob) < META_HEADER, -3).when(size > MAX_SIZE, -6).when((at < 0) | (at > F.length(blob)), -7).when(at + size > F.length(blob), -8).otherwise(size)
    )


def entry(blob: Column, slot: Column) -> tuple[Column, Column]:
    """(offset, size) of a slot."""
    base = (slot * ENTRY.size + HEAD.size).cast("int")
    return read_int32(blob, base), read_int32(blob, base + 4)


def read_tiles(requests: DataFrame, blob: str = "blob") -> DataFrame:
    """requests(x, y, blob) -> with status, data (null on error) and compressed."""
    slot = metatile_slot(F.col("x"), F.col("y"))
    status = read_status(F.col(blob), slot)
    at, size = entry(F.col(blob), slot)
    data = F.when(F.col("status") >= 0, F.substring(F.col(blob), (at + 1).cast("int"), size.cast("int")))
    return requests.withColumn("status", status.cast("int")).withColumn("data", data).withColumn("compressed", F.substring(F.col(blob), 1, 4).cast("string") == "METZ").drop(blob)


def decoded(metatiles: DataFrame, blob: str = "blob") -> DataFrame:
    """metatiles(.., blob) -> 64 rows each: slot, size and data."""
    m = metatiles.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    at, size = entry(F.col(blob), F.col("slot"))
    return m.withColumns({"size": size, "data": F.substring(F.col(blob), (at + 1).cast("int"), size.cast("int"))}).drop(blob)


def _packed(x: pa.Array, y: pa.Array, z: pa.Array, tiles: pa.Array) -> pa.Array:
    """Containers of a batch: ``tiles`` are lists of (slot, data) by slot, so what follows the index lies together already."""
    slots, data = (f.combine_chunks() if isinstance(f, pa.ChunkedArray) else f for f in tiles.flatten().flatten())
    counts = tiles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    data = data.fill_null(b"")
    lengths = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.zeros((len(tiles), SLOTS), np.int64)
    sizes[np.repeat(np.arange(len(tiles)), counts), slots.to_numpy(zero_copy_only=False)] = lengths
    index = np.empty((len(tiles), SLOTS, 2), "<i4")
    index[:, :, 0] = META_HEADER + np.cumsum(sizes, axis=1) - sizes
    index[:, :, 1] = sizes
    body = data.to_pylist()
    heads = zip(x.to_pylist(), y.to_pylist(), z.to_pylist(), index, ends - counts, ends, strict=True)
    return pa.array([HEAD.pack(b"META", SLOTS, a, b, c) + i.tobytes() + b"".join(body[first:end]) for a, b, c, i, first, end in heads], pa.binary())


def encoded(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """tiles(keys.., mx, my, z, x, y, data) -> one container for each metatile; of tiles repeated with
    other contents the greatest stays, whatever the order of rows. A group is at most 64 tiles, as slots are made unique before they are collected."""
    slot = metatile_slot(F.col("x"), F.col("y")).cast("int")
    one = tiles.withColumn("slot", slot).groupBy(*keys, "slot").agg(F.max("data").alias("data"))
    grouped = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "data"))).alias("tiles"))
    packed = F.arrow_udf(_packed, "binary")
    return grouped.select(*keys, packed("mx", "my", "z", "tiles").alias("blob"))
