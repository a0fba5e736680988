"""The render queue: admission as a set, and the exact sequential replay.

Admission of a closed batch needs, for each request, whether it is the first of its
metatile, its rank among first requests of its queue, and its rank among those that
overflow to Dirty. Ranks matter only up to the caps (256 and 8000), so instead of numbering
all requests in one task, each queue's first ``cap`` requests are found by a bounded top-k,
which every partition does for itself before the merge; nothing larger is gathered.

The queue as it runs, with fetches in between, has one state that every request may change. ``replayed`` runs through slices of
requests one after the other; what goes on from slice to slice is what waits in the queues, which the caps bound, and
a table of the metatiles admitted.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileflow.constants import DIRTY_LIMIT, FETCH_ORDER, QUEUE_OF, REQ_LIMIT
from tileflow.sources import shared

KEY = ["style", "z", "mx", "my"]
#: Requests that one task runs through in order. At most ``SLICES`` slices are made; more requests make them longer.
SLICE, SLICES = 1_000_000, 32


def wanted(cmd: str = "cmd"):
    out = F.lit(None)
    for command, queue in QUEUE_OF.items():
        out = F.when(F.col(cmd) == command, F.lit(queue)).otherwise(out)
    return out


def admission(requests: DataFrame, req_limit: int = REQ_LIMIT, dirty_limit: int = DIRTY_LIMIT) -> DataFrame:
    """requests with wanted, first_req (the admitted one of the metatile, or its first) and queue (where that went, or Dropped).

    Until Dirty is full nothing is dropped, so the first request of a metatile is the one that counts. A dropped request
    leaves nothing behind: a later one of its metatile is admitted if its own queue still has room, see ``_late``.
    """
    first = requests.groupBy(*KEY).agg(F.min_by(F.struct("req_id", wanted().alias("wanted")), "req_id").alias("f"))
    # staged, as it is cut twice, and as a metatile of a low zoom can have a third of all requests
    first = shared.staged(first.select(*[F.col(k).alias(f"k_{k}") for k in KEY], F.col("f.req_id").alias("f"), F.col("f.wanted").alias("w")), "first")
    queues = [q for q in FETCH_ORDER if q != "Dirty"]
    # the first requests that each queue takes; every task hands on its first ``req_limit`` of each
    rank = F.row_number().over(Window.partitionBy("w").orderBy("f"))
    takes = first.where(F.col("w").isin(queues)).select("w", "f", rank.alias("n")).where(F.col("n") <= req_limit).groupBy("w").agg(F.collect_list("f").alias("f")).collect()  # four rows of req_limit
    takes = {r.w: r.f for r in takes}
    own = F.coalesce(reduce(lambda x, q: x.when(F.col("w") == q, F.col("f") <= max(takes[q])), takes, F.when(F.lit(False), F.lit(False))), F.lit(False))
    placed = first.withColumn("own", own)
    cut = placed.where("NOT own").select("f").orderBy("f").limit(dirty_limit).agg(F.count("*").alias("n"), F.max("f").alias("last")).first()
    full = cut.n >= dirty_limit
    early = F.lit(not full) if not full or cut.n == 0 else F.col("f") <= cut["last"]
    placed = placed.withColumn("early", early)
    same = reduce(lambda x, k: x & (F.col(k) == F.col(f"k_{k}")), KEY, F.lit(True))
    queue = F.when(F.col("own"), F.col("w")).otherwise(F.lit("Dirty"))
    # a queue that has no room when Dirty gets full has none later, so only the others can take what was dropped before
    room = {q: req_limit - sum(cut.n > 0 and f <= cut["last"] for f in takes.get(q, [])) for q in queues} if full else {}
    room = {q: n for q, n in room.items() if n > 0}
    if not room or placed.where("NOT early").isEmpty():
        known = placed.select(*[f"k_{k}" for k in KEY], "f", F.when(F.col("early"), queue).otherwise(F.lit("Dropped")).alias("q"))
        return requests.join(known, same).select(*requests.columns, wanted().alias("wanted"), F.col("f").alias("first_req"), F.col("q").alias("queue"))
    late = _late(requests, placed, room, req_limit)
    of_late = reduce(lambda x, k: x & (F.col(f"k_{k}") == F.col(f"late_{k}")), KEY, ~F.col("early"))
    placed = placed.join(late, of_late, "left")
    queue = F.when(F.col("early"), queue).otherwise(F.coalesce("late_queue", F.lit("Dropped")))
    placed = shared.staged(placed.select(*[f"k_{k}" for k in KEY], "f", F.col("late_req").alias("late"), queue.alias("q")), "placed")
    out = requests.join(placed, same)
    before = F.coalesce(F.col("req_id") < F.col("late"), F.lit(False))  # dropped, before one that was admitted
    return out.select(*requests.columns, wanted().alias("wanted"), F.when(before, F.col("f")).otherwise(F.coalesce("late", "f")).alias("first_req"), F.when(before, "Dropped").otherwise(F.col("q")).alias("queue"))


def _late(requests: DataFrame, placed: DataFrame, room: dict[str, int], req_limit: int) -> DataFrame:
    """Metatiles not seen before Dirty was full -> (late_<key>, late_req, late_queue) of those admitted after it.

    Of a metatile only its first request for each queue with room can matter. At most ``req_limit`` go to each of these
    queues, and each of them can make one candidate of another queue void, so the first ``req_limit`` candidates of a
    queue for each queue with room decide: few rows, run through in order.
    """
    open_keys = placed.where("NOT early").select(*[F.col(f"k_{k}").alias(k) for k in KEY])
    offers = requests.withColumn("wanted", wanted()).where(F.col("wanted").isin(list(room))).join(open_keys, KEY, "left_semi").groupBy(*KEY, "wanted").agg(F.min("req_id").alias("req_id"))
    few = reduce(DataFrame.unionAll, [offers.where(F.col("wanted") == q).orderBy("req_id").limit(len(room) * req_limit) for q in room])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, got = dict(room), {}
        for style, z, mx, my, q, req_id in g.sort_values("req_id").itertuples(index=False):
            if (style, z, mx, my) not in got and left[q] > 0:
                left[q] -= 1
                got[style, z, mx, my] = (req_id, q)
        return pd.DataFrame([(*k, *v) for k, v in got.items()], columns=[*[f"late_{k}" for k in KEY], "late_req", "late_queue"])

    types = dict(requests.dtypes)
    return few.groupBy().applyInPandas(run, ", ".join(f"late_{k} {types[k]}" for k in KEY) + f", late_req {types['req_id']}, late_queue string")


def replies(admitted: DataFrame) -> DataFrame:
    """(req_id, admitted_queue, reply): Ignore waits for a result, NotDone is answered at once."""
    mine = F.col("req_id") == F.col("first_req")
    waits = F.col("queue").isin("Prio", "Request", "Low")
    # a bulk item answers its own request, but not those that come to it later
    reply = F.when(F.col("queue").isin("Dropped", "Dirty"), "NotDone").when(waits | mine, "Ignore").otherwise("NotDone")
    return admitted.select("req_id", F.when(mine & (F.col("queue") != "Dropped"), F.col("queue")).alias("admitted_queue"), reply.alias("reply"))


def fetch_order(items: DataFrame, k: int) -> DataFrame:
    """The next k items: by queue, then by arrival. A top-k, not a full sort."""
    rank = F.lit(None).cast("int")
    for i, q in enumerate(FETCH_ORDER):
        rank = F.when(F.col("queue") == q, F.lit(i)).otherwise(rank)
    return items.withColumn("queue_rank", rank).orderBy("queue_rank", "req_id").limit(k)


class RenderQueue:
    """Sequential queue: dedup, caps, overflow, fetch order, cancel, statistics."""

    WAITING = ("Request", "Prio", "Low", "Render")

    def __init__(self, req_limit: int = REQ_LIMIT, dirty_limit: int = DIRTY_LIMIT):
        self.limit = {q: dirty_limit if q == "Dirty" else req_limit for q in FETCH_ORDER}
        self.queues: dict[str, OrderedDict] = {q: OrderedDict() for q in (*FETCH_ORDER, "Render")}
        self.pending: dict[tuple, dict] = {}
        self.waits: dict[int, dict[tuple, dict]] = {}  # fd -> the items it waits for
        self.dropped = 0
        self.rendered = dict.fromkeys(FETCH_ORDER, 0)
        self.render_ms = dict.fromkeys(FETCH_ORDER, 0)
        self.zoom: dict[int, list[int]] = {}

    def add(self, key: tuple, cmd: str, fd: int) -> str:
        item = self.pending.get(key)
        if item:
            if item["queue"] in self.WAITING:
                self._wait(key, item, fd)
                return "Ignore"
            return "NotDone"
        queue, reply = QUEUE_OF[cmd], "Ignore"
        if queue == "Dirty" or len(self.queues[queue]) >= self.limit[queue]:
            queue, reply, fd = "Dirty", "NotDone", -1
            if len(self.queues[queue]) >= self.limit[queue]:
                self.dropped += 1
                return "NotDone"
        self.put(key, queue, fd)
        return reply

    def put(self, key: tuple, queue: str, fd: int) -> None:
        self.pending[key] = self.queues[queue][key] = item = {"queue": queue, "from": queue, "fds": []}
        self._wait(key, item, fd)

    def _wait(self, key: tuple, item: dict, fd: int) -> None:
        item["fds"].append(fd)
        if fd != -1:
            self.waits.setdefault(fd, {})[key] = item

    def fetch(self) -> tuple | None:
        for q in FETCH_ORDER:
            if self.queues[q]:
                key, item = self.queues[q].popitem(last=False)
                item["queue"] = "Render"
                self.queues["Render"][key] = item
                self.rendered[q] += 1
                return key
        return None

    def done(self, key: tuple, ms: int) -> list[int]:
        item = self.pending.pop(key)
        self.queues["Render"].pop(key, None)
        for fd in set(item["fds"]) & self.waits.keys() if self.waits else ():
            self.waits[fd].pop(key, None)
            if not self.waits[fd]:
                del self.waits[fd]
        if ms > 0:
            self.render_ms[item["from"]] += ms
            n = self.zoom.setdefault(key[1], [0, 0])
            n[0] += 1
            n[1] += ms
        return item["fds"]

    def cancel(self, fd: int) -> None:
        """Not in Low and Dirty, until they are rendered."""
        for key, item in list(self.waits.get(fd, {}).items()):
            if item["queue"] in ("Request", "Render", "Prio", "Bulk"):
                item["fds"] = [-1 if x == fd else x for x in item["fds"]]
                del self.waits[fd][key]
        if not self.waits.get(fd, True):
            del self.waits[fd]


def replay(events: Iterable[tuple], req_limit: int = REQ_LIMIT, dirty_limit: int = DIRTY_LIMIT, queue: RenderQueue | None = None) -> list[tuple]:
    """events (req_id, key, cmd) in order; cmd may also be Fetch or Cancel -> (req_id, outcome). A queue that is given goes on."""
    q, out = queue or RenderQueue(req_limit, dirty_limit), []
    for req_id, key, cmd in events:
        if cmd == "Fetch":
            k = q.fetch()
            out.append((req_id, "-" if k is None else "/".join(map(str, k))))
        elif cmd == "Cancel":
            q.cancel(req_id)
            out.append((req_id, "cancelled"))
        else:
            out.append((req_id, q.add(key, cmd, req_id)))
    return out


def replayed(requests: DataFrame, fetch: Column, req_limit: int = REQ_LIMIT, dirty_limit: int = DIRTY_LIMIT, size: int = SLICE) -> DataFrame:
    """requests(req_id, key, cmd) in order of req_id, with a fetch after each for which ``fetch`` holds -> (req_id, outcome), a row for
    each request and each fetch. Nothing is ever done, so what was fetched stays in Render.

    Metatiles are numbered, so that the ordered pass carries no texts. A metatile that was admitted in an earlier slice and waits
    no longer is in Render: a join says so for the requests of a slice.
    """
    # staged, as the numbers must stay what they are
    keys = shared.staged(requests.select(*KEY).distinct().withColumn("no", F.monotonically_increasing_id()), "metatiles")
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"k_{k}")), KEY, F.lit(True))
    numbered = requests.join(keys.select(*[F.col(k).alias(f"k_{k}") for k in KEY], "no"), same)
    rows = shared.staged(numbered.select("req_id", "no", "cmd", fetch.alias("fetch")).repartitionByRange("req_id").sortWithinPartitions("req_id"), "requests")
    parts = min(SLICES, max(1, math.ceil(rows.count() / size)))
    edges = rows.agg(F.percentile_approx("req_id", [i / parts for i in range(1, parts)]).alias("e")).first().e if parts > 1 else []
    edges = sorted(set(edges or []))  # at most SLICES
    waiting: list[tuple[str, int]] = []
    out: list[DataFrame] = []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = rows
        if low is not None:
            part = part.where(F.col("req_id") > low)
        if high is not None:
            part = part.where((F.col("req_id") <= high) | F.col("req_id").isNull() if low is None else F.col("req_id") <= high)
        known = F.lit(False)
        if out:
            admitted = reduce(DataFrame.unionAll, out).where("kind = 'add' AND no IS NOT NULL").select(F.col("no").alias("known_no"))
            part, known = part.join(admitted, F.col("no") == F.col("known_no"), "left"), F.col("known_no").isNotNull()
        part = part.select("req_id", "no", "cmd", "fetch", known.alias("known")).repartition(1).sortWithinPartitions("req_id", "no")
        out.append(shared.staged(part.mapInArrow(_slice(waiting, req_limit, dirty_limit), "kind string, req_id long, outcome string, no long"), "replayed"))
        left = out[-1].where("kind = 'left'").orderBy("req_id").collect()  # at most 4 * req_limit + dirty_limit
        waiting = [(r.outcome, r.no) for r in left]
    every = reduce(DataFrame.unionAll, out)
    fetched = every.where("kind = 'fetch'").select("req_id", "no").join(keys, "no", "left")
    name = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in KEY])
    fetched = fetched.select("req_id", F.when(F.col("no").isNull(), "-").otherwise(name).alias("outcome"))
    return every.where("kind = 'add'").select("req_id", "outcome").unionAll(fetched)


def _slice(waiting: list[tuple[str, int]], req_limit: int, dirty_limit: int):
    """Function of a slice's sorted batches(req_id, no, cmd, fetch, known) -> rows of kind add (no: what it admitted), fetch (no: what was
    fetched) and left (in req_id's place their order: what waits at the end, in which queue)."""
    schema = pa.schema([("kind", pa.string()), ("req_id", pa.int64()), ("outcome", pa.string()), ("no", pa.int64())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def values(column: pa.Array) -> list:
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, rendering = RenderQueue(req_limit, dirty_limit), set()
        for name, no in waiting:
            queue.put(no, name, -1)
        for b in batches:
            rows = []
            for req_id, no, cmd, fetch, known in zip(*[values(b.column(c)) for c in ("req_id", "no", "cmd", "fetch", "known")], strict=True):
                if no in queue.pending:
                    rows.append(("add", req_id, queue.add(no, cmd, -1), None))
                elif known or no in rendering:
                    rows.append(("add", req_id, "Ignore", None))
                else:
                    reply = queue.add(no, cmd, -1)
                    rows.append(("add", req_id, reply, no if no in queue.pending else None))
                if fetch:
                    got = queue.fetch()
                    if got is not None:
                        queue.done(got, 0)
                        rendering.add(got)
                    rows.append(("fetch", req_id, None, got))
            yield batch(rows)
        yield batch([("left", i, item["queue"], no) for i, (no, item) in enumerate(x for q in FETCH_ORDER for x in queue.queues[q].items())])

    return run
