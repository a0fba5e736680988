"""Token buckets for clients: the exact shared replay, and independent buckets by client.

What clients share is the top-up alone, which is made when one of them meets an empty bucket and a token is due. Between
top-ups no client depends on another, and there are no more of them than tokens that a client could get at most. So ``exact``
runs clients through independently under a list of top-ups, and corrects the list until each of its entries is what its client does.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.constants import CLIENT_PENALTY
from tileflow.functions.web import ServerConfig
from tileflow.sources import shared


@dataclass
class Buckets:
    """Buckets of all clients with one lazy top-up for both resources, run in time order.

    A first request makes a full bucket and is free. An empty bucket tops up and tries again, up
    to three times; from the second failure on, the client is held for three seconds.
    """

    cfg: ServerConfig
    start_us: int
    whitelist: frozenset = frozenset()
    users: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.tile_fill = self.render_fill = self.start_us

    def allow(self, client: str | None, now_us: int, missing: bool) -> bool:
        if client in self.whitelist:
            return True
        if client is None:
            return False
        u = self.users.get(client)
        if u is None:
            self.users[client] = [self.cfg.delaypool_tile_size, self.cfg.delaypool_render_size]
            return True
        for attempt in range(3):
            denied = False
            if u[0] > 0:
                u[0] -= 1
            else:
                denied = True
            if missing:
                if u[1] > 0:
                    u[1] -= 1
                else:
                    denied = True
            if not denied:
                return True
            if attempt:
                now_us += CLIENT_PENALTY * 1_000_000
            # a client held for seconds may have topped up at a later time than this one's: that is not taken back
            tiles, renders = max(0, (now_us - self.tile_fill) // self.cfg.delaypool_tile_rate), max(0, (now_us - self.render_fill) // self.cfg.delaypool_render_rate)
            if tiles > 0 or renders > 0:
                for x in self.users.values():
                    x[0], x[1] = min(x[0] + tiles, self.cfg.delaypool_tile_size), min(x[1] + renders, self.cfg.delaypool_render_size)
            self.tile_fill += self.cfg.delaypool_tile_rate * tiles
            self.render_fill += self.cfg.delaypool_render_rate * renders
        return False


@dataclass
class Bucket:
    """One client's bucket by the textbook: tokens drip in, a request takes what it needs or nothing."""

    cfg: ServerConfig
    tiles: float | None = None
    renders: float | None = None
    last_us: int = 0

    def allow(self, now_us: int, missing: bool) -> bool:
        if self.tiles is None:
            self.tiles, self.renders, self.last_us = float(self.cfg.delaypool_tile_size), float(self.cfg.delaypool_render_size), now_us
        gone = max(0, now_us - self.last_us)
        self.tiles = min(self.tiles + gone / self.cfg.delaypool_tile_rate, self.cfg.delaypool_tile_size)
        self.renders = min(self.renders + gone / self.cfg.delaypool_render_rate, self.cfg.delaypool_render_size)
        self.last_us = max(self.last_us, now_us)
        if self.tiles < 1 or missing and self.renders < 1:
            return False
        self.tiles -= 1
        self.renders -= missing
        return True

    def full_us(self) -> int:
        """When both tokens are back to the full: from then on the bucket is as a new one."""
        return math.ceil(self.last_us + max((self.cfg.delaypool_tile_size - self.tiles) * self.cfg.delaypool_tile_rate, (self.cfg.delaypool_render_size - self.renders) * self.cfg.delaypool_render_rate))


#: A top-up: (us, req_id, attempt) of the request that makes it, tokens of both kinds given since the start, with it.
TopUp = tuple[int, int, int, int, int]


def exact(requests: DataFrame, cfg: ServerConfig) -> DataFrame:
    """requests(req_id, client_ip, us, missing) -> (req_id, allowed), as ``Buckets`` allows them in order of (us, req_id).

    A pass runs all clients through under the top-ups known. Up to the first that is missing or false, states are exact: each pass
    settles one more at least, and what clients do after it is the guess for the next; after a false one without a guess.
    """
    rows = requests.repartition("client_ip").sortWithinPartitions("client_ip", "us", "req_id").persist(StorageLevel.DISK_ONLY)
    start = rows.agg(F.min("us")).first()[0]
    known: list[TopUp] = []
    settled = 0
    while True:
        found = rows.mapInArrow(_through(cfg, start, known, report=True), "place int, us long, req_id long, attempt int, tiles long, renders long")
        found = found.groupBy("place", "tiles", "renders").agg(F.min(F.struct("us", "req_id", "attempt")).alias("m")).collect()  # at most two a top-up, or a guess
        new = sorted((*r.m, r.tiles, r.renders) for r in found if r.place is None)
        confirmed = {r.place for r in found if r.place is not None}
        bad = next((i for i in range(len(known)) if i not in confirmed), len(known))
        if not new and bad == len(known):
            break
        if new and (bad == len(known) or new[0] < known[bad]):
            sure = [*known[: bisect_left(known, new[0])], new[0]]
        else:
            sure = known[:bad]
        guess = sorted({*new, *(known[i] for i in confirmed)}) if len(sure) > settled else []
        known, settled = sure, len(sure)
        for t in guess[bisect_left(guess, sure[-1]) :] if sure else guess:
            last = known[-1][3:] if known else (0, 0)
            if t[3] >= last[0] and t[4] >= last[1] and t[3:] != last:
                known = [*known, t]
    out = shared.staged(rows.mapInArrow(_through(cfg, start, known, report=False), "req_id long, allowed boolean"), "allowed")
    rows.unpersist()
    return out


def _through(cfg: ServerConfig, start: int, known: list[TopUp], report: bool):
    """Function of batches sorted by client and time -> (req_id, allowed), or if ``report`` the places of the top-ups known that their
    clients do make, and the first new one for each state of the pool."""
    names = ["place", "us", "req_id", "attempt", "tiles", "renders"]
    schema = pa.schema([(n, pa.int32() if n in ("place", "attempt") else pa.int64()) for n in names])
    tile_size, render_size, tile_rate, render_rate = cfg.delaypool_tile_size, cfg.delaypool_render_size, cfg.delaypool_tile_rate, cfg.delaypool_render_rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, at, tiles, renders, tiles_given, renders_given = None, 0, 0, 0, 0, 0
        confirmed: set[int] = set()
        new: dict[tuple[int, int], TopUp] = {}
        for b in batches:
            allowed = []
            for c, us, req_id, missing in zip(*[b.column(n).to_pylist() for n in ("client_ip", "us", "req_id", "missing")], strict=True):
                if c is None:
                    allowed.append(False)
                    continue
                if c != client:
                    client, tiles, renders = c, tile_size, render_size
                    at = bisect_left(known, (us, req_id))
                    tiles_given, renders_given = known[at - 1][3:] if at else (0, 0)
                    allowed.append(True)
                    continue
                while at < len(known) and known[at] < (us, req_id):
                    more, more_renders = max(0, known[at][3] - tiles_given), max(0, known[at][4] - renders_given)
                    tiles, renders = min(tiles + more, tile_size), min(renders + more_renders, render_size)
                    tiles_given, renders_given, at = tiles_given + more, renders_given + more_renders, at + 1
                now, ok = us, False
                for attempt in range(3):
                    denied = False
                    if tiles > 0:
                        tiles -= 1
                    else:
                        denied = True
                    if missing:
                        if renders > 0:
                            renders -= 1
                        else:
                            denied = True
                    if not denied:
                        ok = True
                        break
                    if attempt:
                        now += CLIENT_PENALTY * 1_000_000
                    more, more_renders = max(0, (now - start) // tile_rate - tiles_given), max(0, (now - start) // render_rate - renders_given)
                    if more or more_renders:
                        tiles, renders = min(tiles + more, tile_size), min(renders + more_renders, render_size)
                        tiles_given, renders_given = tiles_given + more, renders_given + more_renders
                        t = (us, req_id, attempt, tiles_given, renders_given)
                        if at < len(known) and known[at] == t:
                            confirmed.add(at)
                            at += 1
                        else:
                            new[t[3:]] = min(new.get(t[3:], t), t)
                allowed.append(ok)
            if not report:
                yield pa.RecordBatch.from_arrays([b.column("req_id"), pa.array(allowed, pa.bool_())], names=["req_id", "allowed"])
        if report:
            rows = [*[(i, *known[i]) for i in sorted(confirmed)], *[(None, *t) for t in new.values()]]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return run
