"""Groups of sorted rows inside mapInPandas, without gathering more than one group at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def grouped(keys: list[str], each: Callable[[pd.DataFrame], pd.DataFrame | None], columns: list[str]) -> Callable:
    """A mapInPandas function that calls ``each`` on every run of rows equal in keys, whole across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in itertools.chain(batches, [None]):  # None: the end
            if b is not None and not len(b):
                continue
            if b is not None:
                held = b if held is None else pd.concat([held, b], ignore_index=True)
            if held is None:
                continue
            k = held[keys].to_numpy()
            cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            parts = np.split(np.arange(len(held)), cut)
            whole = parts if b is None else parts[:-1]
            found = [r for p in whole if len(p) > 1 and (r := each(held.iloc[p])) is not None]
            yield pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=columns)
            held = None if b is None else held.iloc[parts[-1]].reset_index(drop=True)

    return run


def together(keys: list[str], each: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], columns: list[str]) -> Callable:
    """Like ``grouped``, but ``each`` gets all whole groups of a batch at once, of two rows or more each, with a number for
    the group of each row: for groups so small that a call for each would be the work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in itertools.chain(batches, [None]):  # None: the end
            if b is not None and not len(b):
                continue
            if b is not None:
                held = b if held is None else pd.concat([held, b], ignore_index=True)
            if held is None:
                continue
            k = held[keys].to_numpy()
            group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
            whole = len(held) if b is None else int(np.searchsorted(group, group[-1]))
            many = np.flatnonzero(np.bincount(group)[group[:whole]] > 1)
            found = each(held.iloc[many].reset_index(drop=True), group[many]) if len(many) else None
            yield found if found is not None else pd.DataFrame(columns=columns)
            held = None if b is None else held.iloc[whole:].reset_index(drop=True)

    return run
