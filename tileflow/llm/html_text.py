"""Main text of web pages by maximum-scoring subsequence.

A page is cut into tags and words. Each feature of a word (the elements that enclose it, their
classes, ids and roles, the kind of its innermost block, how many words that block has) has a weight,
the log-odds of words inside against words outside the article, learned from labelled pages
(pages whose own markup names the article). A word scores the sum of its weights, so words
in paragraphs score positive and words in menus or footers negative; tags score negative. One
linear scan (Kadane) finds the contiguous run with the largest sum, the content region.

An element whose own names weigh less than ``MASK`` is a foreign part (an advert amid the article, reader
comments below it): its words are left out, and it neither adds to a region nor ends one. An element that
holds nearly all positive words of the page is a frame around the content instead, whatever its name. What names
usually mean (``PRIOR``) is a prior of ``PRIOR_WORDS`` words to each weight, which learned counts soon outweigh.

Fitting reads at most about ``train_pages`` of the labelled pages, chosen by a hash (a documented
bound); all pages are extracted from their whole html, one row at a time, in time linear in its length.

Defined results
    null or empty html: empty text, 0 characters. No labelled page: the prior weights alone. No
    positive word: empty text. Equal sums: the run that begins first. Null or repeated ids
    and urls: each row is extracted. Empty table: an empty result. Very long or deeply nested pages: extracted
    whole. Broken markup (unclosed tags, quotes, comments) is read as far as it goes, as browsers do.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.arrow import computed

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|[^<]++|<""",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z][\w-]*+)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Fixed values of the html standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body article main section div aside nav header footer table ul ol dl td th form blockquote".split())
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

LABELS = frozenset(("article", "main"))
#: Never text that a reader sees, or a control.
NEVER = frozenset("head button select dialog svg object video audio canvas map".split())
PLAIN = frozenset("html body div span article main".split())
#: Prior weights of elements, and names that have the prior weight ``NAMED`` as class, id or role.
PRIOR = {"nav": -3.0, "footer": -3.0, "aside": -3.0, "header": -3.0, "form": -3.0, "menu": -3.0, "a": -0.5, "p": 1.0, "=1": -0.5, "=2": -0.5}
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus reply replies respond share sharing social related recommended widget popup modal overlay search pagination pager toolbar skip complementary contentinfo".split()
)
#: Words of a name that say the element holds, or lacks, such a part.
ABOUT = frozenset("with has no without".split())
NAMED, PRIOR_WORDS = -3.0, 50
#: Bounds of a weight and of the share that all words have, what a word has before its weights, and a tag's cost.
LIMIT, BIAS_LIMIT, WORD_PRIOR, TAG_COST = 3.0, 1.0, 0.5, -0.1
#: Own names that weigh less make a foreign part. It is a frame if less than this share of positive words is outside.
MASK, OUTSIDE = -1.5, 0.02
#: Words of foreign parts; little, so that an advert does not end the article around it.
LEFT_OUT = -0.1


def prior(feature: str) -> float:
    if feature[0] in ".#":
        words = set(re.findall("[a-z]+", feature))
        return NAMED if words & NAMES and not words & ABOUT else 0.0
    return PRIOR.get(feature, 0.0)


class Weights(dict):
    """feature -> weight; a feature without one has its prior. "" is the weight of every word."""

    def __missing__(self, feature: str) -> float:
        return prior(feature)


def _names(attrs: str, ids: bool) -> tuple[list[str], bool]:
    """Features by class, role and, where asked for, id; whether the element is hidden."""
    names, hidden = [], False
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "role"):
                names += [f".{x}" for x in value.split()]
            elif key == "id" and ids:
                names += [f"#{x}" for x in value.split()]
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and bool(re.search(r"display\s*:\s*none", value))
    return names, hidden


@dataclass(slots=True)
class Element:
    tag: str
    own: tuple[str, ...]  # its features
    names: tuple[str, ...]  # those of them that can make it a foreign part
    hidden: bool
    inside: bool  # a labelled element, or in one
    block: str  # tag of the innermost element that is not inline


def events(page: str | None) -> Iterator[tuple[str, object]]:
    """("open", Element), ("close", its tag), ("tag", name of one that opens nothing) and ("text", text) in page order.

    Open elements are also listed by name, so that a tag finds what it closes without a walk through all open ones."""
    page = page or ""
    stack: list[Element] = [Element("", (), (), False, False, "")]
    where: dict[str, list[int]] = {}
    scopes: list[int] = []
    wide: list[int] = []  # scopes other than table cells
    last = lambda found: found[-1] if found else 0

    def closed(to: int) -> Iterator[tuple[str, object]]:
        while len(stack) > to:
            e = stack.pop()
            where[e.tag].pop()
            for found in (scopes, wide):
                if found and found[-1] == len(stack):
                    found.pop()
            yield "close", e.tag

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                yield "text", html_lib.unescape(m[0])
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            if i := last(where.get(tag)):
                yield from closed(i)
            else:
                yield "tag", tag
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            scope = last(wide if tag == "tr" else scopes)
            if i := min((i for x in SIBLINGS.get(tag, ("p",)) if (i := last(where.get(x))) >= max(scope, 1)), default=0):
                yield from closed(i)
        if tag in VOID:
            yield "tag", tag
            if tag == "br":
                yield "text", " "
            continue
        if tag in RAW:
            yield "tag", tag
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        top = stack[-1]
        names, hidden = _names(attrs, not top.inside and tag not in HEADINGS)
        if tag in PRIOR and PRIOR[tag] == NAMED and not (tag == "header" and top.inside):  # a heading group inside the article belongs to it
            names.append(tag)
        own = tuple(dict.fromkeys(names if tag in PLAIN or tag == "header" else [tag, *names]))
        if not attrs.rstrip().endswith("/") or tag not in ("svg", "path"):
            where.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
                if tag not in CELLS:
                    wide.append(len(stack))
            stack.append(Element(tag, own, tuple(names), hidden or tag in NEVER, top.inside or tag in LABELS or "articlebody" in attrs.lower(), top.block if tag in INLINE else tag))
            yield "open", stack[-1]
    yield from closed(1)


def _size(n: int) -> str:
    """Feature of a block of n words."""
    return f"={min(n.bit_length(), 8)}"


def _is_name(feature: str) -> bool:
    return feature[:1] in (".", "#") or PRIOR.get(feature) == NAMED


def weights_of(counts: dict[str, tuple[int, int]]) -> Weights:
    """feature -> (words inside labelled elements, words outside) to weights. "" holds all words, "*" those that teach other features than names."""
    bound = lambda x, limit: max(-limit, min(limit, x))
    if not all(counts.get("", (0, 0))):
        return Weights({"": 0.0})

    def learned(f: str) -> float:
        """Log of the feature's share of words inside over that outside, both smoothed by its share of all words."""
        (i, o), (n_in, n_out) = counts[f], counts.get("" if _is_name(f) else "*", (0, 0))
        share = PRIOR_WORDS * (i + o) / (n_in + n_out)
        w = bound(math.log((i + share) / (n_in + PRIOR_WORDS) / ((o + share) / (n_out + PRIOR_WORDS))), LIMIT)
        return (w * (i + o) + prior(f) * PRIOR_WORDS) / (i + o + PRIOR_WORDS)

    n_in, n_out = counts[""]
    return Weights({"": bound(math.log(n_in / n_out), BIAS_LIMIT)} | {f: learned(f) for f in counts if f not in ("", "*")})


def feature_counts(page: str | None) -> Counter:
    """Words by (feature, inside a labelled element) of a page that has one; else empty.

    Words outside that a name explains by its prior (a menu's, a footer's) count for names only: that they stand in lists
    or under headings says nothing against the lists and headings of articles. Such words inside (an advert's) count for nothing."""
    out: Counter = Counter()
    total = {False: [0, 0], True: [0, 0]}  # words outside, inside: for other features, for names
    open_at: dict[str, list] = {}  # feature -> [open elements with it, words outside and inside before the first]
    stack = [(Element("", (), (), False, False, ""), False)]
    block, labelled = 0, False
    for kind, x in events(page):
        top, explained = stack[-1]
        if kind == "text":
            if not (top.hidden or top.inside and explained) and (n := len(x.split())):
                total[True][top.inside] += n
                if not explained:
                    total[False][top.inside] += n
                    out[f"^{top.block}", top.inside] += n
                    block += n
            continue
        tag = x.tag if kind == "open" else x
        if tag not in INLINE and block:
            out[_size(block), top.inside] += block
            block = 0
        if kind == "open":
            labelled |= x.inside
            x.hidden |= top.hidden
            # what encloses the labelled element says nothing of its parts
            stack.append((x, explained and x.inside == top.inside or any(prior(f) == NAMED for f in x.names)))
            for f in x.own:
                open_at.setdefault(f, [0, *total[_is_name(f)]])[0] += 1
        elif kind == "close":
            for f in stack.pop()[0].own:
                seen = open_at[f]
                seen[0] -= 1
                if not seen[0]:
                    del open_at[f]
                    for inside in (False, True):
                        out[f, inside] += total[_is_name(f)][inside] - seen[1 + inside]
    if block:
        out[_size(block), False] += block
    for inside in (False, True):
        out["", inside] += total[True][inside]
        out["*", inside] += total[False][inside]
    return +out if labelled else Counter()


def best_run(scores: list[float]) -> tuple[int, int]:
    """Range with the largest sum, the first of equal ones; (0, 0) if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


@dataclass(slots=True)
class Tokens:
    """The page in order: texts (None: a tag), whether a tag ends a block, log-odds of a text's words, foreign part it is in."""

    text: list[str | None]
    breaks: list[bool]
    odds: list[float]
    part: list[int]
    masked: list[bool]  # by part; 0 is the page itself


def weighed(page: str | None, weights: dict[str, float]) -> Tokens:
    of = weights.__getitem__ if isinstance(weights, Weights) else lambda f: weights.get(f, 0.0)
    t = Tokens([], [], [], [], [False])
    up, fixed, positive = [0], [False], [0]  # of each part: the part around it, whether it can't be a frame, positive words
    base = WORD_PRIOR + of("")
    total, opened = base, Counter()
    stack: list[tuple[Element, int, bool]] = [(Element("", (), (), False, False, ""), 0, False)]  # element, part, whether its features count
    block: list[int] = []

    def ends() -> None:
        """The block's length is known: it counts for all its words."""
        n = {i: len(t.text[i].split()) for i in block}
        own = of(_size(sum(n.values()))) if sum(n.values()) else 0.0
        for i in block:
            t.odds[i] += own
            if t.odds[i] > 0:
                positive[t.part[i]] += n[i]
        block.clear()

    def put(text: str | None, breaks: bool, odds: float) -> None:
        t.text.append(text)
        t.breaks.append(breaks)
        t.odds.append(odds)
        t.part.append(stack[-1][1])

    for kind, x in events(page):
        if kind == "text":
            block.append(len(t.text))
            put(x, False, total + of(f"^{stack[-1][0].block}"))
            continue
        tag = x.tag if kind == "open" else x
        if tag not in INLINE and block:
            ends()
        if kind == "open":
            part = stack[-1][1]
            if foreign := x.hidden or bool(x.names) and sum(map(of, x.names)) < MASK:
                up.append(part)
                fixed.append(x.hidden or any(f in PRIOR and f != "form" for f in x.names))
                positive.append(0)
                part = len(up) - 1
            stack.append((x, part, not foreign))
            if not foreign:
                for f in x.own:
                    opened[f] += 1
                    total += of(f) if opened[f] == 1 else 0.0
        put(None, tag not in INLINE, 0.0)
        if kind == "close":
            e, _, counted = stack.pop()
            for f in e.own if counted else ():
                opened[f] -= 1
                total -= of(f) if not opened[f] else 0.0
    ends()
    for i in range(len(up) - 1, 0, -1):
        positive[up[i]] += positive[i]
    for i in range(1, len(up)):
        frame = not fixed[i] and positive[i] > 0 and positive[0] - positive[i] < OUTSIDE * positive[i]
        t.masked.append(t.masked[up[i]] or not frame)
    return t


def word_scores(t: Tokens) -> list[float]:
    """One score for each token: its words' together, or a tag's cost."""
    out = []
    for text, odds, part in zip(t.text, t.odds, t.part, strict=True):
        if text is None:
            out.append(0.0 if t.masked[part] else TAG_COST)
        else:
            out.append((LEFT_OUT if t.masked[part] else max(-1.0, min(1.0, odds / 2))) * len(text.split()))
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    t = weighed(page, weights)
    scores = word_scores(t)
    a, b = best_run(scores)
    content = [i for i in range(a, b) if scores[i] > 0] or [b]
    blocks, now = [], []
    for i in range(a, b):
        if (text := t.text[i]) is not None:
            if not (t.masked[t.part[i]] and content[0] < i < content[-1]):  # foreign parts amid the content; the scan leaves out those around it
                now.append(text)
        elif t.breaks[i] and now:
            blocks.append(" ".join("".join(now).split()))
            now = []
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(x for x in blocks if x)


def learn(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", train_pages: int = 5000) -> Weights:
    """Weights from about ``train_pages`` of the labelled pages, all of them where there are fewer."""
    labelled = pages.where(F.col(html_col).rlike("(?i)<(?:article|main)[\\s>]|articlebody"))
    n = labelled.agg(F.count("*").alias("n")).first().n
    share = min(1.0, train_pages / max(n, 1))
    chosen = labelled.where(F.pmod(F.xxhash64(id_col, html_col), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for page in b["html"]:
                total.update(feature_counts(page))
        yield pd.DataFrame([(f, inside, n) for (f, inside), n in total.items()], columns=["f", "inside", "n"]).astype({"inside": bool, "n": "int64"})

    parts = chosen.select(F.col(html_col).alias("html")).mapInPandas(count, "f string, inside boolean, n long")
    found = parts.groupBy("f").agg(F.sum(F.expr("CASE WHEN inside THEN n ELSE 0 END")).alias("i"), F.sum(F.expr("CASE WHEN inside THEN 0 ELSE n END")).alias("o"))
    return weights_of({r.f: (r.i, r.o) for r in found.collect()})


def extracted(pages: DataFrame, weights: dict[str, float], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""

    def make():
        def each(html: list) -> list:
            text = [extract(x, weights) for x in html]
            return [text, [len(x) for x in text]]

        return each

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return computed(rows, ["html"], make, "text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def page_report(pages: DataFrame) -> DataFrame:
    return extracted(pages, learn(pages))
