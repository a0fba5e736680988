"""Byte chunks of connections put together to frames again, and answers met with the requests that wait for them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tileflow.constants import REQUEST_TIMEOUT

#: Bytes of a frame by version.
SIZES = {1: 20, 2: 64, 3: 144}


def cut(pending: bytes) -> tuple[list[bytes], bytes, bool]:
    """(whole frames, the bytes after them, whether the connection is closed by a frame of unknown version). As from a socket, a
    version counts only once the 20 bytes that all versions have are there."""
    frames, at = [], 0
    while len(pending) - at >= SIZES[1]:
        size = SIZES.get(int.from_bytes(pending[at : at + 4], "little"))
        if size is None:
            return frames, b"", True
        if len(pending) - at < size:
            break
        frames.append(pending[at : at + size])
        at += size
    return frames, pending[at:], False


def reassembled(chunks: DataFrame) -> DataFrame:
    """chunks(conn, seq, chunk), bytes of a connection in the order of seq -> (conn, n: from 0, frame).

    A connection's bytes are a sequence, so they pass through one task; that holds an unfinished frame and nothing else. What follows a
    frame of unknown version, and a last frame that never ends, is dropped with the connection."""
    schema = pa.schema([("conn", to_arrow_type(chunks.schema["conn"].dataType)), ("n", pa.int64()), ("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, pending, n, closed = None, False, b"", 0, False
        for b in batches:
            rows: list[tuple] = []
            for conn, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not begun or conn != now:
                    now, begun, pending, n, closed = conn, True, b"", 0, False
                if closed or not chunk:
                    continue
                frames, pending, closed = cut(pending + chunk)
                rows += [(conn, n + i, f) for i, f in enumerate(frames)]
                n += len(frames)
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    dealt = chunks.repartition("conn").sortWithinPartitions("conn", "seq").select("conn", "chunk")
    return dealt.mapInArrow(run, f"conn {chunks.schema['conn'].dataType.simpleString()}, n long, frame binary")


def in_time(asked_us: Column, answered_us: Column, seconds: int) -> Column:
    return (answered_us >= asked_us) & (answered_us <= asked_us + seconds * 1_000_000)


def answered(requests: DataFrame, answers: DataFrame, key: list[str], seconds: int = REQUEST_TIMEOUT) -> DataFrame:
    """requests(.., key, us), answers(key, us), times in microseconds -> requests with answered_us, the first answer to their key within
    ``seconds``, or null: they timed out. Answers to other keys are not theirs.

    A request looks no further than ``seconds`` ahead, so time is cut into stretches of that length: an answer is in its own and in the one before,
    and requests and answers of one key and stretch are run through once, the latest first. No pair is made.
    """
    stretch = F.floor(F.col("us") / (seconds * 1_000_000)).cast("long")
    asked = requests.select(*key, "us", stretch.alias("stretch"), F.lit(None).cast("long").alias("answer"), F.struct(*requests.columns).alias("row"))
    none = F.lit(None).cast(asked.schema["row"].dataType)
    given = answers.select(*key, "us", F.explode(F.array(stretch, stretch - 1)).alias("stretch"), F.col("us").alias("answer"), none.alias("row"))
    later = Window.partitionBy(*key, "stretch").orderBy(F.col("us").desc(), F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # the latest come first, so the last answer seen is the next one
    found = asked.unionByName(given).withColumn("next", F.last("answer", ignorenulls=True).over(later)).where("row IS NOT NULL")
    return found.select("row.*", F.when(in_time(F.col("us"), F.col("next"), seconds), F.col("next")).alias("answered_us"))
