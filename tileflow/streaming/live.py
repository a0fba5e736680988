"""The same operators on streams.

State is bounded: buckets that are not full, unfinished frames, metatiles that wait for a render, polls and requests up to the
watermark. Where the semantics are shared by all requests (the queue's caps) the stream has one key and says so; all else has
a key a client, connection, metatile or counter.
"""

from __future__ import annotations

import json
import os
import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tileflow.constants import REQUEST_TIMEOUT
from tileflow.functions.web import ServerConfig
from tileflow.operators import connections, freshness
from tileflow.operators.queue import RenderQueue
from tileflow.operators.throttle import Bucket
from tileflow.sources import wire


def frames(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Requests decoded from files of wire frames (column ``frame``), at most ``max_files`` files a batch."""
    raw = spark.readStream.schema("req_id long, frame binary").option("maxFilesPerTrigger", max_files).parquet(path)
    return wire.upgraded(wire.decode(raw))


def throttled(requests: DataFrame, cfg: ServerConfig, late: str = "1 minute") -> DataFrame:
    """requests(req_id, client_ip, us, missing) -> (req_id, allowed), a bucket for each client.

    A full bucket is as good as none: once the watermark passes the time at which a client's bucket is full again it is
    forgotten, so state is held for clients that lately asked for much."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "req_id"])
        b = Bucket(cfg, *state.get) if state.exists else Bucket(cfg)
        allowed = [b.allow(int(us), bool(m)) for us, m in zip(rows["us"], rows["missing"], strict=True)]
        state.update((b.tiles, b.renders, b.last_us))
        state.setTimeoutTimestamp(max(b.full_us() // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"req_id": rows["req_id"].to_numpy(), "allowed": allowed})

    timed = requests.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    return timed.groupBy("client_ip").applyInPandasWithState(step, "req_id long, allowed boolean", "tiles double, renders double, last_us long", "append", GroupStateTimeout.EventTimeTimeout)


def assembled(chunks: DataFrame, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """chunks(conn, seq: from 0, ts, chunk) of many connections -> (conn, n, frame), as ``connections.reassembled``.

    State of a connection: an unfinished frame, and chunks that came before their turn. A connection is forgotten once the watermark is
    ``idle_ms`` past its last chunk."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending, n, turn, closed, seqs, early = state.get if state.exists else (b"", 0, 0, False, [], [])
        held, seen = dict(zip(seqs, map(bytes, early), strict=True)), 0
        for b in batches:
            seen = max(seen, int(b["ms"].max()))
            held |= {int(s): bytes(c) if c is not None else b"" for s, c in zip(b["seq"], b["chunk"], strict=True) if s >= turn}
        out, pending = [], bytes(pending)
        while turn in held:
            chunk = held.pop(turn)
            turn += 1
            if not closed:
                frames, pending, closed = connections.cut(pending + chunk)
                out += frames
        state.update((pending, n + len(out), turn, closed, list(held), list(held.values())))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"conn": key[0], "n": range(n, n + len(out)), "frame": out})

    conn = chunks.schema["conn"].dataType.simpleString()
    held = "pending binary, n long, turn long, closed boolean, seqs array<long>, early array<binary>"
    timed = chunks.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("conn").applyInPandasWithState(step, f"conn {conn}, n long, frame binary", held, "append", GroupStateTimeout.EventTimeTimeout)


def answered(requests: DataFrame, answers: DataFrame, key: list[str], seconds: int = REQUEST_TIMEOUT, late: str = "10 seconds") -> DataFrame:
    """requests(req_id, key, ts), answers(key, ts) -> (req_id, asked, answered): a row for each answer in time, and once the watermark has passed
    that time, one of null for a request without any. Both sides are forgotten then."""
    asked = requests.withWatermark("ts", late).select("req_id", *[F.col(k).alias(f"r_{k}") for k in key], F.col("ts").alias("asked"))
    given = answers.withWatermark("ts", late).select(*[F.col(k).alias(f"a_{k}") for k in key], F.col("ts").alias("answered"))
    same = reduce(lambda x, k: x & (F.col(f"r_{k}") == F.col(f"a_{k}")), key, F.lit(True))
    timely = (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return asked.join(given, same & timely, "leftOuter").select("req_id", "asked", "answered")


def coalesced(events: DataFrame, late: str = "10 minutes", abandoned_ms: int = 600_000) -> DataFrame:
    """events(seq, ts, style, z, mx, my, req_id) in the order of seq, req_id null where the metatile is done -> (req_id, outcome): renders, or waits
    for the one that does; then answered, for all that waited.

    State of a metatile: the requests that wait, from the first until it is done; a render is given up, and answered so, once the watermark is
    ``abandoned_ms`` past its last request."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"req_id": waiting, "outcome": "abandoned"})
            return
        out, rows = [], pd.concat(list(batches)).sort_values("seq")
        for req in rows["req_id"]:
            if req is None or pd.isna(req):
                out += [(r, "answered") for r in waiting]
                waiting = []
            else:
                out.append((int(req), "waits" if waiting else "renders"))
                waiting.append(int(req))
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(int(rows["ms"].max()), state.getCurrentWatermarkMs()) + abandoned_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["req_id", "outcome"])

    # ids travel as texts, as pandas keeps no long integers beside nulls
    events = events.withWatermark("ts", late).withColumns({"req_id": F.col("req_id").cast("string"), "ms": F.unix_millis("ts")})
    return events.groupBy("style", "z", "mx", "my").applyInPandasWithState(step, "req_id long, outcome string", "waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def deltas(polls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """polls(key, poll, n, us) of growing counters -> (key, poll, seconds, dn, dus) since the key's poll before.

    Polls wait until the watermark passes them, so those that come late or out of order take their turn; later ones are dropped.
    State of a key: the last poll that counted, and those that wait. A counter that went back gives a negative difference."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ats, ns, uss = state.get if state.exists else (None, [], [], [])
        held = {a: (n, u) for a, n, u in zip(ats, ns, uss, strict=True)}
        if not state.hasTimedOut:
            for b in batches:
                held |= {int(a): (int(n), int(u)) for a, n, u in zip(b["at"], b["n"], b["us"], strict=True) if last is None or a > last[0]}
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        for at in sorted(a for a in held if a <= mark):
            n, us = held.pop(at)
            if last is not None:
                out.append((key[0], at, (at - last[0]) // 1_000_000, n - last[1], us - last[2]))
            last = [at, n, us]
        state.update((last, list(held), [n for n, _ in held.values()], [u for _, u in held.values()]))
        if held:
            state.setTimeoutTimestamp(max(min(held) // 1000, mark // 1000 + 1))
        yield pd.DataFrame(out, columns=["key", "at", "seconds", "dn", "dus"])

    timed = polls.withWatermark("poll", late).withColumn("at", F.unix_micros("poll"))
    key = polls.schema["key"].dataType.simpleString()
    out = timed.groupBy("key").applyInPandasWithState(step, f"key {key}, at long, seconds long, dn long, dus long", "last array<long>, ats array<long>, ns array<long>, uss array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_micros("at").alias("poll"), "seconds", "dn", "dus")


def judged(requests: DataFrame, imports: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], refresh: int = 300) -> DataStreamWriter:
    """requests(style, ts, mtime, ..) with planet_ts and expired as known at their time. ``imports`` reads the table of imports (style, at, planet_ts) as
    it is when a batch begins, so imports that come while the stream runs count from their time on."""

    def each(batch: DataFrame, batch_id: int) -> None:
        known = freshness.with_import_then(batch, imports(), refresh)
        write(known.withColumn("expired", F.coalesce(F.col("mtime") < F.col("planet_ts"), F.lit(True))), batch_id)

    return requests.writeStream.foreachBatch(each)


def queued(events: DataFrame) -> DataFrame:
    """events(req_id, style, z, mx, my, cmd), cmd also Fetch, Done or Cancel -> (req_id, outcome) of the one render queue."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q: RenderQueue = pickle.loads(state.get[0]) if state.exists else RenderQueue()
        out: list[tuple[int, str]] = []
        for r in pd.concat(list(batches)).sort_values("req_id").itertuples(index=False):
            tile = (r.style, r.z, r.mx, r.my)
            if r.cmd == "Fetch":
                got = q.fetch()
                out.append((r.req_id, "-" if got is None else "/".join(map(str, got))))
            elif r.cmd == "Done":
                out.append((r.req_id, ",".join(map(str, q.done(tile, 1))) if tile in q.pending else "-"))
            elif r.cmd == "Cancel":
                q.cancel(r.req_id)
                out.append((r.req_id, "cancelled"))
            else:
                out.append((r.req_id, q.add(tile, r.cmd, r.req_id)))
        state.update((pickle.dumps(q),))
        yield pd.DataFrame(out, columns=["req_id", "outcome"])

    one = events.withColumn("queue", F.lit("render"))
    return one.groupBy("queue").applyInPandasWithState(step, "req_id long, outcome string", "queue binary", "append", GroupStateTimeout.NoTimeout)


def polled(outcomes: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """outcomes(ts, z, read_us) -> reads and their time by zoom and poll window; windows close at the watermark."""
    return outcomes.withWatermark("ts", late).groupBy(F.window("ts", every), "z").agg(F.count("*").alias("n_reads"), F.sum("read_us").alias("dur_us")).select(F.col("window.end").alias("poll"), "z", "n_reads", "dur_us")


def write_text(lines: list[str], path: str) -> None:
    """A whole file at once: readers see the old text or the new."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "w") as f:
        f.writelines(f"{x}\n" for x in lines)
    os.replace(temporary, path)


def added_up(total: dict[str, int], lines: list[str]) -> list[str]:
    """Counters ("name: value") added to those since the start, in the order of their first batch."""
    for line in lines:
        name, _, value = line.rpartition(": ")
        total[name] = total.get(name, 0) + int(value)
    return [f"{name}: {n}" for name, n in total.items()]


def stats_file(stream: DataFrame, as_lines: Callable[[DataFrame], DataFrame], path: str, every: str = "10 seconds", **trigger: Any) -> DataStreamWriter:
    """Every ten seconds, the counters since the stream's start as lines of a statistics file on the driver.

    The totals are kept beside it with the number of the last batch and what they were before it: a stream that starts again from its
    checkpoint goes on with them, and a batch that runs again replaces what its first run added. Both files are replaced whole."""
    kept = f"{path}.totals"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = as_lines(batch).orderBy("line_no").collect()  # a line for each counter, whatever the batch's size
        last: dict[str, Any] = {"batch": None, "total": {}}
        if os.path.exists(kept):
            with open(kept) as f:
                last = json.load(f)
        before = last["before"] if last["batch"] == batch_id else last["total"]
        total = dict(before)
        lines = added_up(total, [r.line for r in rows])
        write_text([json.dumps({"batch": batch_id, "before": before, "total": total})], kept)
        write_text(lines, path)

    return stream.writeStream.foreachBatch(write).trigger(**(trigger or {"processingTime": every}))
