"""Secret scans by assignment-aware lexing.

Two layers. The base layer finds three fixed patterns. The method adds to it: the text is
lexed for assignments as source code and configuration files write them (``name = "x"``,
``name: x``, ``"name": "x"``, ``name := 'x'``, ``name => "x"``, ``export NAME=x``), giving
pairs of a target name and literals. A name bound to a literal is a constant; where a later
assignment uses that name its literals are carried over, and ``"a" + "b"`` joins literals.
A literal is scored by how sensitive its target name is and by how random it looks, and a
span of kind ``literal`` is added where the score reaches ``THRESHOLD``. Joined literals are
also scored as the one text they make; where that reaches it, those of them that alone do
not get a span of kind ``part``.

Texts are scanned whole, one row at a time, with no shuffle, in time linear in the text: a use of a constant refers to
its value instead of copying it, and no stretch is lexed again for each operator before it.

Defined results
    null text: scanned as the empty text, no spans. Ties (spans with one start): ordered by kind
    as in ``KINDS``, then end. A method span that a base span contains is not repeated. Repeated
    rows: each is scanned. Empty table: an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.arrow import computed, replaced

KINDS = ("assign", "access", "hex", "literal", "part")
THRESHOLD = 1.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: For these two a match shorter than the minimum leaves nothing longer inside it, so the minimum can be part of the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

OPERATOR = re.compile(r"[:=]")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")
QUOTED = re.compile(r"""[rRbBuUfF]{0,2}(?:\"\"\"(?P<d3>.*?)\"\"\"|'''(?P<s3>.*?)'''|"(?P<d>(?:[^"\\\n]|\\.)*)"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`)""", re.S)
#: Ends where the next pair begins (``a=1&b=2``); equals signs only as padding.
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#&=]+(?:={1,2}(?![^\s"'`,;(){}\[\]<>#&]))?""")
IDENT = re.compile(r"[A-Za-z_$][\w$.]*\Z", re.A)
JOINER = re.compile(r"\+|\.\.|\|\|")
JOIN = re.compile(r"[ \t]*(?:\+|\.\.|<>|\|\|)[ \t]*\n?[ \t]*")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A word as people write it: one case, capitalised or camel case, with at most three digits after it. Atomic, so that no text takes more than linear time.
_WORD = r"(?>(?>[A-Z]?[a-z]{2,20}(?:[A-Z][a-z]{2,20})*|[A-Z]{1,20}|[a-z])[0-9]{0,3})"
_NAME = rf"(?>{_WORD}(?:[._-](?:{_WORD}|[0-9]{{1,4}}))*)"
_SEGMENT = rf"(?>[.~]?{_NAME}|[0-9]{{1,8}}|\.\.?)"
_HOST = rf"(?:{_NAME}|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})(?::[0-9]{{1,5}})?"
#: Values that stand for one or lead to one, by their full shape: a secret may begin like any of them.
PLACEHOLDER = re.compile(
    rf"(?:(?:\$\{{[\w.]*\}}|\{{\{{[\w.|]*\}}\}}|%\(\w+\)[a-zA-Z]?)(?:[/:@._-]?(?:\$\{{[\w.]*\}}|\{{\{{[\w.|]*\}}\}}|%\(\w+\)[a-zA-Z]?))*|<{_NAME}>|(?i:x{{3,}}|\*{{3,}}|\.{{3,}}|true|false|null|none|nil|todo|changeme|example|placeholder)"
    rf"|(?i:your)(?:[_-]{_WORD})+|(?i:process\.env|os\.environ)(?:\.[A-Za-z_]\w*)?(?:[\[(][\"']?\w+[\"']?[\])])?|/{_SEGMENT}(?:/{_SEGMENT})+/?|(?i:https?)://{_HOST}(?:/{_SEGMENT})*/?)\Z"
)

#: Code points that a joined placeholder (a path, a URL) has at most, and different characters beyond which a joined text counts as random.
LONGEST, ALPHABET = 512, 256

#: Words of a name and how strongly each, alone or as a pair, marks a secret.
SENSITIVE = {"password": 0.8, "passwd": 0.8, "pwd": 0.8, "passphrase": 0.8, "secret": 0.7, "token": 0.6, "apikey": 0.7, "credential": 0.7, "credentials": 0.7, "bearer": 0.6, "auth": 0.45, "authorization": 0.5, "pass": 0.5, "pw": 0.5, "salt": 0.4, "pin": 0.3, "key": 0.2}
PAIRS = {("api", "key"): 0.7, ("access", "key"): 0.7, ("private", "key"): 0.7, ("secret", "key"): 0.8, ("signing", "key"): 0.7, ("encryption", "key"): 0.7, ("client", "secret"): 0.8, ("connection", "string"): 0.5, ("session", "id"): 0.45, ("master", "key"): 0.7}


#: One of these is in every name that scores, so a text without any needs no lexing.
STEMS = [w for w in sorted({*SENSITIVE, *(p[0] if p[0] in SENSITIVE else p[1] if p[1] in SENSITIVE else p[0] for p in PAIRS)}) if not any(x != w and x in w for x in SENSITIVE)]


@lru_cache(4096)
def _scored(name: str) -> float:
    words = [w.lower() for part in re.split(r"[^A-Za-z0-9]+", name) for w in CAMEL.findall(part)]
    return max([SENSITIVE.get(w, 0.0) for w in words] + [PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False)], default=0.0)


def name_score(name: str) -> float:
    """How strongly a name marks a secret."""
    return _scored(name) if len(name) <= 200 else _scored.__wrapped__(name)  # long ones are not remembered


def _score(n: int, counts: Counter) -> float:
    """Up to 0.8 by length, alphabet and entropy."""
    if n < 6 or len(counts) < 4:
        return 0.0
    if len(counts) > ALPHABET:
        return 0.8
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(0.8, 0.1 * classes + 0.1 * bits + 0.01 * min(n, 20))


def literal_score(value: str) -> float:
    """0 for what cannot be a secret."""
    return 0.0 if any(map(str.isspace, value)) or PLACEHOLDER.match(value) else _score(len(value), Counter(value))


def reaches(name: float, score: float) -> bool:
    return score > 0 and name + score >= THRESHOLD


def _name_before(text: str, end: int) -> str:
    """The name that ends at ``end``, past blanks and a closing quote or bracket."""
    while end and text[end - 1] in " \t":
        end -= 1
    while end and text[end - 1] in "\"'`]":
        end -= 1
    start = end
    while start and text[start - 1] in NAME_CHARS:
        start -= 1
    return text[start:end].strip("-.")


@dataclass(slots=True)
class Joined:
    """The text that joined pieces make, as far as its score needs it."""

    pieces: int = 0
    counts: Counter = field(default_factory=Counter)  # characters
    text: str | None = ""  # None once longer than any placeholder
    blank: bool = False

    def add(self, x: Joined) -> None:
        self.pieces = min(self.pieces + x.pieces, 2)
        self.blank |= x.blank
        if self.blank:  # cannot be a secret any more
            self.counts, self.text = Counter(), None
            return
        if len(self.counts) <= ALPHABET:
            self.counts.update(x.counts)
            if self.counts.total() > 1 << 60:  # x = x + x, again and again: shares matter, not counts
                self.counts = Counter({c: max(n >> 30, 1) for c, n in self.counts.items()})
        self.text = None if self.text is None or x.text is None or len(self.text) + len(x.text) > LONGEST else self.text + x.text

    @property
    def score(self) -> float:
        if self.pieces < 2 or self.blank or self.text is not None and PLACEHOLDER.match(self.text):
            return 0.0
        return _score(self.counts.total(), self.counts)


def _piece(value: str) -> Joined:
    return Joined(1, Counter(value), value if len(value) <= LONGEST else None, any(map(str.isspace, value)))


@dataclass(slots=True)
class Value:
    """What an assignment binds: its literals, and the earlier values it refers to."""

    name: float  # score of the target name
    literals: list[tuple[int, int]]
    parts: list[tuple[int, int]]  # literals that are a piece of the joined text
    refers: list[int]
    joined: Joined | None = None  # of one literal: made where it is referred to

    def whole(self, text: str) -> Joined:
        if self.joined is None:
            self.joined = _piece(text[slice(*self.parts[0])]) if self.parts else Joined()
        return self.joined


def _operands(text: str, at: int) -> tuple[list[tuple[int, int, bool]], int]:
    """(start, end, quoted) of the operands after an assignment operator, joined ones too, and where they end."""
    out = []
    while True:
        if m := QUOTED.match(text, at):
            out.append((*m.span(m.lastgroup), True))
            end = m.end()
        elif m := BARE.match(text, at):
            s, end = m.span()
            # an operator right before a quote joins: p+"x"
            if (op := next((x for x in ("+", "..", "||") if text.endswith(x, s, end)), "")) and QUOTED.match(text, end):
                end -= len(op)
            out.append((s, end, False))
        else:
            return out, at
        if not (j := JOIN.match(text, end)) or j.end() == end:
            return out, end
        at = j.end()


def _split(text: str, name: float, s: int, e: int) -> Iterator[tuple[float, int, int]]:
    """A bare value as (score of the name, start, end): ``a:password:x`` binds x to password, and no stretch is in two values."""
    at = start = s
    while (colon := text.find(":", at, e)) >= 0:
        if own := name_score(text[at:colon]):
            if start < at:
                yield name, start, at - 1
            name, start = own, colon + 1
        at = colon + 1
    yield name, start, e


def values(text: str) -> list[Value]:
    """One value for each assignment, in text order, so that a value refers to earlier ones only. Each stretch of the
    text is lexed a bounded number of times: a bare value is passed over, the inside of quotes is lexed for itself."""
    constants: dict[str, int] = {}
    found: list[Value] = []
    passed = 0
    for m in OPERATOR.finditer(text):
        op, end = m.start(), m.end()
        if op < passed or op and text[op - 1] in "=!<>:+-*/|&^%~" and not (text[op] == "=" and text[op - 1] == ":"):
            continue
        if text[end : end + 1] in ("=", ":") and text[op : end + 1] != ":=" or text.startswith("//", end):
            continue
        if text[op] == ":" and text[end : end + 1] == "=":
            continue
        if text[end : end + 1] == ">":
            end += 1
        name = _name_before(text, op - (text[op - 1 : op] == ":"))
        if not name:
            continue
        while text[end : end + 1] in (" ", "\t") and text[end : end + 1]:
            end += 1
        operands, _ = _operands(text, end)
        if not operands:
            continue
        own = Value(name_score(name), [], [], [], Joined() if len(operands) > 1 else None)
        for s, e, quoted in operands:
            if not quoted:
                passed = max(passed, e)
                if text[s:e].lower() in ("bearer", "basic") and (b := BARE.match(text, e + 1)):
                    s, e = b.span()
                names = [text[s:e]] if text[s:e] in constants else JOINER.split(text[s:e])
                if all(x in constants for x in names):
                    own.joined = own.joined or Joined()
                    for at in (constants[x] for x in names):
                        own.refers.append(at)
                        own.joined.add(found[at].whole(text))
                    continue
                *inner, (score, s, e) = _split(text, own.name, s, e)
                found += [Value(n, [(a, b)], [], []) for n, a, b in inner]
                if inner:
                    found.append(Value(score, [(s, e)], [], []))
                    continue
            own.literals.append((s, e))
            # an unquoted name without a value is a reference, not a part of the text
            if quoted or not IDENT.match(text[s:e]):
                own.parts.append((s, e))
                if own.joined:
                    own.joined.add(_piece(text[s:e]))
        constants[name] = len(found)
        found.append(own)
    return found


def literal_spans(text: str) -> set[tuple[str, int, int]]:
    """Literals that reach the threshold alone, and the other parts of joined ones that reach it together.

    Backwards over the values: a value passes the strongest name that it is bound to, and whether a text that holds
    it reaches the threshold, to those it refers to, so every literal is scored once, however often its name is used.
    """
    low = text.lower()
    if not any(w in low for w in STEMS):
        return set()
    found = values(text)
    name = [v.name for v in found]
    whole = [v.name > 0 and v.joined is not None and reaches(v.name, v.joined.score) for v in found]
    alone, parts = set(), set()
    for i in range(len(found) - 1, -1, -1):
        for at in found[i].refers:
            name[at] = max(name[at], name[i])
            whole[at] |= whole[i]
        if name[i]:
            alone |= {x for x in found[i].literals if reaches(name[i], literal_score(text[x[0] : x[1]]))}
        if whole[i]:
            parts |= {x for x in found[i].parts if x[0] < x[1]}
    return {("literal", *x) for x in alone} | {("part", *x) for x in parts - alone}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each in order."""
    text = text or ""
    base = base_spans(text)
    extra = {x for x in literal_spans(text) if not any(s <= x[1] and x[2] <= e for _, s, e in base)}
    return _order(base), _order([*base, *extra])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """Overlapping spans become one mark."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        def each(texts: list) -> list:
            found = [scan(t) for t in texts]
            n = [Counter(k for k, _, _ in base) for base, _ in found]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            return [[c[k] for c in n] for k in ("assign", "access", "hex")] + [digests, [joined(spans) for _, spans in found]]

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return computed(rows, ["text"], make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input with every span found replaced by ``mark``; no row is dropped, other columns stay."""
    return replaced(docs, text_col, lambda: lambda texts: [t if t is None else redact(t, scan(t)[1], mark) for t in texts])
