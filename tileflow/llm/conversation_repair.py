"""Repair of conversations by error-correcting Earley parsing.

The roles of a conversation should read (system? (user assistant)+)?. The grammar of that is left-linear; terminals are the first
letters of roles, and error productions let a row be deleted, take another role, or be put in where none is::

    S -> E | B        E -> nothing | E del      nothing kept so far
    Y -> E | M        M -> E s | M del          a system row is kept
    U -> Y u | B u | U del                      ends with a user row
    B -> U a | B del                            ends with an assistant row

A chart item is a nonterminal that ends at a row (every one begins where its parse begins) and retains the least (cost, edits): of two parses of
equal cost the ASCII-least edits. As edits say what each row becomes, no edits of equal cost and equal rows are a prefix of each other, so
least edits of parts make least edits of the whole.

Rows are sorted once over all conversations (by ranges, so a conversation of any length is spread). A task parses the conversations that
lie in its range, up to ``segment_rows`` rows each. Those torn at the edge of a range, and longer ones, are parsed segment by segment from each of the
four nonterminals a segment may begin after; charts of a conversation's segments are then chained, without its texts, and the texts pass
once more in order to be repaired and hashed, one at a time.

Defined results
    Null conv_id: one conversation of its own. Null role or text: one space (so a null text is blank, a null role can't be
    kept). Rows of one turn: by role, then text. Roles of other letters: deleted or given another role. Null turns come first
    and count in no gap. Empty table: no rows. A conversation without rows after damage: zeros, empty edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tileflow.llm.scratch import stage

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Right-hand sides by the nonterminal they begin with: what follows from it at once, and with a terminal.
UNIT = {"E": ("Y",), "M": ("Y",), "U": (), "B": (), "Y": ()}
WITH = {"E": (("s", "M"),), "Y": (("u", "U"),), "B": (("u", "U"),), "U": (("a", "B"),), "M": ()}
#: What a conversation, or a segment, may begin after; what it may end with.
BEGIN, ENDS = "EMUB", "EB"
ROLE = {"u": "user", "a": "assistant"}
BLANK = " \t\n\v\f\r"
SEGMENT_ROWS, SEGMENT_BYTES = 2048, 16 << 20


def faults(role: str, text: str, seen: bool) -> str:
    """First fault of a row: b(lank), d(uplicate), t(runcated), or nothing."""
    own = text.rstrip(BLANK)
    return "b" if not own else "d" if seen else "" if own[-1] in ".!?" else "t"


def parsed(rows: Iterable[tuple[str, str]], start: str = "E") -> dict[str, tuple[int, str]]:
    """(initial, fault) of rows -> the completed items of the last chart: nonterminal -> least (cost, edits)."""
    agenda = [(0, "", start)]
    chart: dict[str, tuple[int, str]] = {}
    for initial, fault in [*rows, (None, "")]:
        chart, scanned = {}, []
        late = TRUNCATED if fault == "t" else 0
        stays = initial is not None and fault in ("", "t")
        while agenda:
            cost, edits, x = heappop(agenda)
            if x in chart:
                continue
            chart[x] = cost, edits
            for y in UNIT[x]:
                heappush(agenda, (cost, edits, y))
            for terminal, y in WITH[x]:
                if terminal != "s":
                    heappush(agenda, (cost + INSERT, edits + "I", y))
                    if stays and initial != terminal:
                        scanned.append((cost + REROLE + late, edits + "R", y))
                if stays and initial == terminal:
                    scanned.append((cost + late, edits + "K", y))
            if initial is not None and x != "Y":
                scanned.append((cost + DELETE, edits + "D", x))
        for item in scanned:
            heappush(agenda, item)
    return {x: v for x, v in chart.items() if x != "Y"}


def repaired(rows: Iterable[tuple[str, str]], edits: str, start: str = "E") -> Iterator[tuple[str, str]]:
    """(role, text) of the rows as the edits leave them."""
    rows, now = iter(rows), start
    for e in edits:
        role, text = next(rows) if e != "I" else (None, "")
        if e == "D":
            continue
        terminal = role[0] if e == "K" else "a" if now == "U" else "u"
        yield (role if e == "K" else ROLE[terminal]), text
        now = {"s": "M", "u": "U", "a": "B"}[terminal]


class Counts:
    """Totals of a run of rows in order, and what its neighbours need to know of it."""

    NAMES = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self) -> None:
        self.n = dict.fromkeys(self.NAMES, 0)
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            self.n[{"b": "blank", "d": "duplicate", "t": "truncated"}[fault]] += 1
        self.follow(initial, initial, turn, turn, 1)

    def follow(self, first: str, last: str, low: int | None, high: int | None, turns: int) -> None:
        if self.last is not None and self.last + first not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.first, self.last = first if self.first is None else self.first, last
        if low is not None:
            self.n["turns"] += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.n["turns"]


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, gone) after the damage by crc32 of ``conv:turn``; a dropped row stays as a mark of its conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    out = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(hit == 0, None).when(hit == 4, "user").otherwise(said(role_col)).alias("role"),
        F.when(hit != 0, text).alias("text"), (hit == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))),
    )
    return out.drop("col")


def as_they_are(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, gone) without damage."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), F.lit(False).alias("gone"))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = 6  # of the report
TORN = "turn long, role string, text string, gone boolean, part long, segment long, at long"


def whole(rows: list[tuple[str, str]], turns: list[int | None]) -> tuple:
    """The report of one conversation."""
    counts, found, seen = Counts(), [], set()
    for (role, text), turn in zip(rows, turns, strict=True):
        fault = faults(role, text, (role, text) in seen)
        seen.add((role, text))
        found.append((role[:1], fault))
        counts.add(turn, role[:1], fault)
    cost, edits = min(v for x, v in parsed(found).items() if x in ENDS)
    text = "\n".join(f"{r}:{t}" for r, t in repaired(rows, edits))
    n = counts.n
    return counts.gaps(), n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, edits, hashlib.sha256(text.encode()).hexdigest()


def _local(conv_type, segment_rows: int, texts: bool):
    """Sorted rows of one range -> reports (or repaired rows, whose ``gone`` is null) of its whole conversations, rows of the torn ones
    with their segment."""
    schema = StructType.fromDDL(REPORT + ", " + TORN)
    arrow = pa.schema([("conv", conv_type), *[(f.name, to_arrow_type(f.dataType)) for f in schema]])
    n_report = len(StructType.fromDDL(REPORT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held: list[tuple] = []
        now, begun, tearing, size, segment, at = None, False, True, 0, 0, 0  # the first conversation may have begun in the range before

        def tear() -> None:
            nonlocal size, segment, at
            for conv, *row in held:
                out.append((conv, *[None] * n_report, *row, part, segment, at))
                at += 1
            held.clear()
            size, segment = 0, segment + 1

        def end() -> None:
            nonlocal size, at
            if tearing:
                tear()
                return
            rows = [(r[2], r[3]) for r in held if not r[4]]
            report = whole(rows, [r[1] for r in held if not r[4]])
            if texts:
                for role, text in repaired(rows, report[EDITS]):
                    out.append((now, *[None] * (n_report + 1), role, text, None, part, -1, at))
                    at += 1
            else:
                out.append((now, *report, *[None] * 7))
            held.clear()
            size = 0

        def flushed() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in arrow]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if begun and row[0] != now:
                    end()
                    tearing = False
                now, begun = row[0], True
                held.append(row)
                size += len(row[3] or "")
                if len(held) >= segment_rows or size >= SEGMENT_BYTES:
                    tearing = True
                    tear()
                    yield flushed()
            if len(out) >= 1000:
                yield flushed()
        tearing = True  # the last one may go on in the next range
        tear()
        yield flushed()

    return run, schema


CHART = "begins string, ends string, low string, high string, blank long, duplicate long, truncated long, illegal long, turns long, costs array<long>, edits array<string>"


def _text(n: int | None) -> str | None:
    return None if n is None else str(n)


def _segment(g: pd.DataFrame) -> pd.DataFrame:
    """The charts of one segment of a torn conversation, from each nonterminal it may begin after to each it may end with. Turns are
    texts here, as pandas keeps no long integers beside nulls."""
    g = g.sort_values("at")
    live = g[~g["gone"]]
    counts, rows = Counts(), []
    for turn, role, text, seen in zip(live["turn"], live["role"], live["text"], live["seen"], strict=True):
        fault = faults(role, text, bool(seen))
        rows.append((role[:1], fault))
        counts.add(None if turn is None else int(turn), role[:1], fault)
    costs, edits = [], []
    for x in BEGIN:
        found = parsed(rows, x)
        costs += [found[y][0] if y in found else -1 for y in BEGIN]
        edits += [found[y][1] if y in found else "" for y in BEGIN]
    first = {k: g[k].iloc[:1].tolist() for k in ("conv_key", "part", "segment")}
    return pd.DataFrame({**first, "begins": [counts.first], "ends": [counts.last], "low": [_text(counts.low)], "high": [_text(counts.high)], **{k: [v] for k, v in counts.n.items()}, "costs": [costs], "edits": [edits]})


def _chain(g: pd.DataFrame) -> pd.DataFrame:
    """All charts of one conversation: its totals, and the edits and the beginning of each segment in the cheapest parse."""
    g = g.sort_values(["part", "segment"]).reset_index(drop=True)
    counts, best = Counts(), {"E": (0, "", ())}
    for r in g.itertuples():
        for k in Counts.NAMES[:4]:
            counts.n[k] += int(getattr(r, k))
        if r.begins is not None:
            low, high = (None, None) if r.low is None else (int(r.low), int(r.high))
            counts.follow(r.begins, r.ends, low, high, int(r.turns))
        nexts: dict[str, tuple[int, str, tuple]] = {}
        for x, (cost, edits, way) in best.items():
            for k, y in enumerate(BEGIN):
                c, e = int(r.costs[4 * BEGIN.index(x) + k]), r.edits[4 * BEGIN.index(x) + k]
                if c >= 0 and (y not in nexts or (cost + c, edits + e) < nexts[y][:2]):
                    nexts[y] = cost + c, edits + e, (way, x, e)
        best = nexts
    cost, edits, way = min((v for y, v in best.items() if y in ENDS), key=lambda v: v[:2])
    steps = []
    while way:
        way, x, e = way
        steps.append((x, e))
    out = g[["conv_key", "part", "segment"]].copy()
    out["start"], out["own"] = [x for x, _ in reversed(steps)], [e for _, e in reversed(steps)]
    totals = {"gaps": counts.gaps(), **{k: counts.n[k] for k in Counts.NAMES[:4]}, "cost": cost, "audit": edits}
    for k, v in totals.items():  # on the first row
        out[k] = [v] + [None] * (len(out) - 1)
    return out


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of torn conversations in order, each segment's edits before its rows -> the hash of each conversation's repaired text."""
    now, hashed, some, edits, rows = None, None, False, ("E", ""), []

    def close() -> None:
        nonlocal some
        for role, text in repaired(rows, edits[1], edits[0]):
            hashed.update(f"{chr(10) * some}{role}:{text}".encode())
            some = True
        rows.clear()

    for b in batches:
        out = []
        for key, own, start, role, text, gone in zip(*[b[c] for c in ("conv_key", "own", "start", "role", "text", "gone")], strict=True):
            if key != now:
                if now is not None:
                    close()
                    out.append((now, hashed.hexdigest()))
                now, hashed, some, edits = key, hashlib.sha256(), False, ("E", "")
            if own is not None:
                close()
                edits = start, own
            elif not gone:
                rows.append((role, text))
        yield pd.DataFrame(out, columns=["conv_key", "repaired_sha256"])
    if now is not None:
        close()
        yield pd.DataFrame([(now, hashed.hexdigest())], columns=["conv_key", "repaired_sha256"])


def _applied(rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """One segment: its rows and its edits -> its rows as repaired."""
    live = rows[~rows["gone"]].sort_values("at")
    found = list(repaired(zip(live["role"], live["text"], strict=True), ways["own"].iloc[0], ways["start"].iloc[0]))
    key, part, segment = ways[["conv_key", "part", "segment"]].iloc[0]
    return pd.DataFrame([(key, part, segment, at, r, t) for at, (r, t) in enumerate(found)], columns=["conv_key", "part", "segment", "at", "role", "text"])


def _parsed(rows: DataFrame, segment_rows: int, texts: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What was done with the conversations that lie in one range; the rows of the others; the edits of the others' segments."""
    order = ["conv", "turn", "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*order, "gone").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    run, added = _local(to_arrow_type(rows.schema["conv"].dataType), segment_rows, texts)
    local = stage(ordered.mapInArrow(run, StructType([rows.schema["conv"], *added])), "talk-local")

    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("conv_key")
    torn = local.where("gone IS NOT NULL").select(key, "conv", F.col("turn").cast("string").alias("turn"), "role", "text", "gone", "part", "segment", "at")
    place = F.struct("part", "at")
    torn = torn.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    again = torn.where("NOT gone").groupBy("conv_key", "said").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    torn = torn.join(stage(again, "talk-again"), ["conv_key", "said"], "left").withColumn("seen", F.coalesce(F.col("first") != place, F.lit(False)))
    torn = stage(torn.select("conv_key", "conv", "turn", "role", "text", "gone", "part", "segment", "at", "seen"), "talk-torn")
    by = "conv_key string, part long, segment long"
    charts = stage(torn.drop("conv").groupBy("conv_key", "part", "segment").applyInPandas(_segment, f"{by}, {CHART}"), "talk-charts")
    totals = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    ways = charts.groupBy("conv_key").applyInPandas(_chain, f"{by}, start string, own string, {totals}")
    return local, torn, stage(ways, "talk-ways")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """rows(conv, turn, role, text, gone) -> (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    local, torn, ways = _parsed(rows, segment_rows, texts=False)
    done = local.where("gone IS NULL").select("conv", *[f.name for f in StructType.fromDDL(REPORT)])
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    texts = torn.select("conv_key", "part", "segment", "at", none("own", "string"), none("start", "string"), "role", "text", "gone")
    edits = ways.select("conv_key", "part", "segment", F.lit(-1).cast("long").alias("at"), "own", "start", none("role", "string"), none("text", "string"), none("gone", "boolean"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.unionByName(edits).repartition(parts, "conv_key").sortWithinPartitions("conv_key", "part", "segment", "at")
    hashes = ordered.mapInPandas(_hashed, "conv_key string, repaired_sha256 string")
    found = ways.where("gaps IS NOT NULL").join(hashes, "conv_key").join(_keys(torn), "conv_key")
    return done.unionByName(found.select(*done.columns))


def _keys(torn: DataFrame) -> DataFrame:
    return torn.groupBy("conv_key").agg(F.first("conv").alias("conv"))


def repaired_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, part, segment, at, role, text): the rows of the repaired conversations; (part, segment, at) is their order."""
    local, torn, ways = _parsed(as_they_are(rows, conv_col, turn_col, role_col, text_col), segment_rows, texts=True)
    done = local.where("gone IS NULL").select("conv", "part", "segment", "at", "role", "text")
    by = ["conv_key", "part", "segment"]
    edits = torn.drop("conv").groupBy(*by).cogroup(ways.select(*by, "start", "own").groupBy(*by)).applyInPandas(_applied, "conv_key string, part long, segment long, at long, role string, text string")
    return done.unionByName(edits.join(_keys(torn), "conv_key").select(*done.columns)).withColumnRenamed("conv", conv_col)


def repair_report(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The report of every conversation after the damage."""
    return repair(damaged(rows, conv_col, turn_col, role_col, text_col), segment_rows).withColumnRenamed("conv", conv_col)


def _oracle() -> str:
    """The same in SQL, row by row: least (cost, edits, text) of the four nonterminals, as structs that compare by their fields."""
    crc = "xor(list_reduce([ascii(x) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')], lambda c, b: list_reduce(range(8), lambda k, i: xor(k >> 1, CASE WHEN (k & 1) = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END), xor(c, CAST(b AS BIGINT))), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    item = lambda x, cost, edit, text="''": f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'r': {x}.r || {text}}}"
    never = "{'c': CAST(1000000000000 AS BIGINT), 'a': '', 'r': ''}"
    kept = lambda x, i: f"CASE WHEN stays AND i = '{i}' THEN {item(x, 'late', 'K', 'line')} END"
    other = lambda x, i, role: f"CASE WHEN stays AND i <> '{i}' THEN {item(x, '2 + late', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"
    put = lambda x, role: item(x, 2, "I", f"chr(10) || '{role}:'")
    after = lambda x, i, role: f"{kept(x, i)}, {other(x, i, role)}"
    inserted = lambda source: f"""SELECT conv_id, k, e, m, u, list_min([b, {put('u', 'assistant')}]) AS b FROM (
      SELECT conv_id, k, e, m, b, list_min([u, {put('e', 'user')}, {put('m', 'user')}, {put('b', 'user')}]) AS u FROM ({source}))"""  # noqa: E731
    return f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
v AS (SELECT conv_id, turn, role, text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM (
  SELECT conv_id, turn, h, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d WHERE h <> 0)),
o AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM v),
f AS (SELECT *, CASE WHEN own = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(own, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  CASE WHEN k > 1 AND lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM o),
g AS (SELECT *, fault IN ('', 't') AS stays, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS late, chr(10) || role || ':' || text AS line FROM f),
p(conv_id, k, e, m, u, b) AS (
  {inserted(f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS e, {never} AS m, {never} AS u, {never} AS b FROM g")}
  UNION ALL
  {inserted(f'''SELECT p.conv_id, g.k, {item('e', 3, 'D')} AS e, list_min([{item('m', 3, 'D')}, {kept('e', 's')}]) AS m,
    list_min([{item('u', 3, 'D')}, {after('e', 'u', 'user')}, {after('m', 'u', 'user')}, {after('b', 'u', 'user')}]) AS u,
    list_min([{item('b', 3, 'D')}, {after('u', 'a', 'assistant')}]) AS b
    FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.k = p.k + 1''')}),
z AS (SELECT conv_id, max(k) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
  count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, CAST(sum(illegal) AS BIGINT) AS illegal FROM g GROUP BY conv_id),
w AS (SELECT z.*, list_min([p.e, p.b]) AS best FROM z JOIN p ON p.conv_id IS NOT DISTINCT FROM z.conv_id AND p.k = z.n)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE_SQL = _oracle()
