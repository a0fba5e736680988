"""The slot for a renderer: a function from a metatile to its tiles, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tileflow.sources.metatile import pack

#: (style, z, mx, my, options) -> bytes of each tile by slot; slots left out stay empty.
Renderer = Callable[[str, int, int, int, str], dict[int, bytes]]


def plain(style: str, z: int, mx: int, my: int, options: str) -> dict[int, bytes]:
    """The default renderer: every tile that exists at the zoom holds its own address, the same on every run."""
    across = 1 << z
    return {dx * 8 + dy: "/".join([style, str(z), str(mx + dx), str(my + dy), *([options] if options else [])]).encode() for dx in range(min(8, across - mx)) for dy in range(min(8, across - my))}


def rendered(metatiles: DataFrame, renderer: Renderer = plain) -> DataFrame:
    """metatiles(style, z, mx, my[, options]) -> with blob, the container of what the renderer made, or null and error where it failed."""
    has_options = "options" in metatiles.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blobs, errors = [], []
            for row in b.itertuples(index=False):
                try:
                    blobs.append(pack(row.mx, row.my, row.z, renderer(row.style, row.z, row.mx, row.my, (row.options or "") if has_options else "")))
                    errors.append(None)
                except Exception as e:  # a renderer's failure is that metatile's answer, not the job's
                    blobs.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(blob=blobs, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in metatiles.schema)
    return metatiles.mapInPandas(run, f"{schema}, blob binary, error string")
