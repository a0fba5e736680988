import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tileflow.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, part long, at long, conv string"
BIG = (1 << 62) + 12345


def conversations(spark, rows):
    return spark.createDataFrame([(*r, True, 1, 1, "x") for r in rows], SCHEMA)


def walks(rows):
    """(cost, edits, repaired) of every way to edit a few rows, inserting at most two rows in a place, whose roles read right."""
    for choice in product(*[[(e, g) for e in ("K", "Ru", "Ra", "D") for g in ("", "u", "a", "ua", "au")] for _ in rows], [("", g) for g in ("", "u", "a", "ua", "au")]):
        cost, edits, out = 0, "", []
        for (e, before), row in zip(choice, [*rows, None], strict=True):
            for x in before:
                cost, edits = cost + 2, edits + "I"
                out.append((x, C.ROLE[x], ""))
            if not e:
                continue
            role, text, fault = row
            if e != "D" and fault in ("b", "d"):
                break
            edits += e[0]
            cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (e != "D" and fault == "t")
            if e != "D":
                out.append((role[:1], role, text) if e == "K" else (e[1], C.ROLE[e[1]], text))
        else:
            if re.fullmatch("(s?(ua)+)?", "".join(x or "-" for x, *_ in out)):
                yield cost, edits, "\n".join(f"{r}:{t}" for _, r, t in out)


row = st.tuples(st.sampled_from(["system", "user", "assistant", " ", "", "tool"]), st.sampled_from(["a.", "b", "c?"]), st.sampled_from(["", "", "", "b", "d", "t"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(row, max_size=3))
def test_parse_equals_all_edits(rows):
    best = min(walks(rows))
    cost, edits = min(v for x, v in C.parsed([(r[:1], f) for r, _, f in rows]).items() if x in C.ENDS)
    assert (cost, edits) == best[:2]
    assert "\n".join(f"{r}:{t}" for r, t in C.repaired([(r, t) for r, t, _ in rows], edits)) == best[2]


def plainly(rows):
    """Whole reports by a program over lists."""
    out = {}
    for conv in {r[0] for r in rows}:
        found = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = role if role is not None else " ", text if text is not None else " "
            hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if hit:
                text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
                found += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in found if t is not None]
        seen, faults = set(), []
        for _, role, text in found:
            own = re.sub(r"[\x20\t-\r]+\Z", "", text)
            faults.append("b" if not own else "d" if (role, text) in seen else "" if own[-1] in ".!?" else "t")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        best = {"": (0, "", ())}  # by the initials kept, shortened to what matters
        short = lambda x: x if len(x) < 2 else "s" if x == "s" else x[-1]
        grow = lambda d, k, v: d.update({k: min(d.get(k, v), v)})
        legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

        def inserts(states):
            for _ in range(3):
                for x, (c, e, t) in list(states.items()):
                    for y in "ua":
                        if (x, y) in legal:
                            grow(states, y, (c + 2, e + "I", (*t, f"{C.ROLE[y]}:")))
            return states

        best = inserts(best)
        for (_, role, text), fault in zip(found, faults, strict=True):
            nexts = {}
            for x, (c, e, t) in best.items():
                grow(nexts, x, (c + 3, e + "D", t))
                if fault in ("", "t"):
                    late = fault == "t"
                    if (x, short(role[:1])) in legal:
                        grow(nexts, role[:1], (c + late, e + "K", (*t, f"{role}:{text}")))
                    for y in "ua":
                        if (x, y) in legal:
                            grow(nexts, y, (c + 2 + late, e + "R", (*t, f"{C.ROLE[y]}:{text}")))
            best = inserts(nexts)
        cost, edits, texts = min(v for x, v in best.items() if x in ("", "a"))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, edits, hashlib.sha256("\n".join(texts).encode()).hexdigest(),
        )
    return out


def talk(seed, n=40, longest=12):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), None, BIG]:
        at = r.randint(0, 3)
        for _ in range(r.randint(1, longest)):
            at += r.choice([1, 1, 1, 1, 3])
            role = r.choice(["user", "assistant"] * 4 + ["system", None, "", "tool", "Übung"])
            text = r.choice(["Yes.", "No!", "What?\n", "so it goes", " \t", "", None, "ü.", "long " * 50 + ".", "a:b\nc."])
            rows.append((c, r.choice([at, at, at, at, None]), role, text))
    return rows + [(c, t, role, text) for c, t, role, text in rows[:20]]


def got(spark, rows, **parameters):
    found = C.repair_report(conversations(spark, rows).repartition(3), **parameters).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r[0]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("segment_rows", [C.SEGMENT_ROWS, 3])
def test_equals_a_plain_program(spark, segment_rows):
    rows = talk(1)
    assert got(spark, rows, segment_rows=segment_rows) == plainly(rows)


def test_one_conversation_has_most_rows(spark):
    rows = talk(2, 5) + [(3, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"text {t % 70}{'.' * (t % 9 > 0)}") for t in range(700)]
    assert got(spark, rows, segment_rows=50) == plainly(rows)


def test_equals_sql(spark):
    rows = talk(3)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = duck.execute(C.ORACLE_SQL).fetchall()
    assert {r[0]: tuple(r[1:]) for r in want} == plainly(rows)


def test_empty_and_dropped(spark):
    assert got(spark, []) == {}
    dropped = [t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0][:2]
    assert got(spark, [(7, t, "user", "Hello.") for t in dropped]) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("segment_rows", [C.SEGMENT_ROWS, 2])
def test_repaired_conversations(spark, segment_rows):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "What now?"), (1, 3, "user", " "), (1, 4, "assistant", "Go"), (2, 0, "user", "Hi."), (2, 1, "assistant", "Hi."), (None, 0, "user", "x."), (4, 1, "user", "a."), (4, 1, "user", "a.")]
    found = C.repaired_conversations(conversations(spark, rows), segment_rows=segment_rows).orderBy("part", "segment", "at").collect()
    texts = {c: [(r.role, r.text) for r in found if r.conv_id == c] for c in (1, 2, None, 4)}
    assert texts[1] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello."), ("user", "What now?"), ("assistant", "Go")]
    assert texts[2] == [("user", "Hi."), ("assistant", "Hi.")]
    assert texts[None] == [("user", "x."), ("assistant", "")]
    assert texts[4] == [("user", "a."), ("assistant", "")]
