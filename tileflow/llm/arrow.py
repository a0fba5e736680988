"""Python on some columns of a table while the others stay in Arrow, bit for bit.

Through pandas, a column of integers with a null becomes floating point and loses ids beyond
2**53; here only the columns a function asks for are turned into Python values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows turned into Python values at a time, whatever the size of an Arrow batch.
ROWS = 500


def computed(rows: DataFrame, of: list[str], make: Callable[[], Callable[..., Any]], added: str, repeat: bool = False) -> DataFrame:
    """``rows`` without the columns ``of``, and with the columns ``added`` that a function makes from them.

    ``make()`` is called once in each task and gives the function. It gets a list for each column of ``of`` and
    returns a list for each added column; with ``repeat`` a list of row numbers comes first, and the
    columns that stay are taken at those rows.
    """
    new = StructType.fromDDL(added)
    stay = [c for c in rows.columns if c not in of]
    schema = StructType([rows.schema[c] for c in stay] + new.fields)
    names, types = [f.name for f in schema], [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                out = each(*[b.column(c).to_pylist() for c in of])
                kept = [b.column(c) for c in stay]
                if repeat:
                    at, *out = out
                    kept = [c.take(pa.array(at, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], names)

    return rows.mapInArrow(run, schema)


def kept(rows: DataFrame, of: str, make: Callable[[], Callable[[list], Any]]) -> DataFrame:
    """The rows for which the function, given a list of the column ``of``, says true; all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                yield b.filter(pa.array(each(b.column(of).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def replaced(rows: DataFrame, of: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows with the column ``of`` made anew from its list; all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                at = b.schema.get_field_index(of)
                yield b.set_column(at, b.schema.field(at), pa.array(each(b.column(at).to_pylist()), b.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)
