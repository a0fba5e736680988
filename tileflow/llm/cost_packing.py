"""Packing documents into fixed-length sequences of near-equal attention cost.

A piece of n tokens is taken to cost ``linear`` * n + ``quadratic`` * n * n: attention is within a piece, all else is
per token. Where tokens lie already, a task opens as many sequences as its tokens fill, and takes
its documents from the longest to the shortest: each goes to the sequence of lowest cost that has room. What does not fit there is
cut off and is an item again, so every sequence is filled to its last place. What fills no sequence, less than one sequence of each
chunk of ``CHUNK`` tokens, goes up a tree: nodes of about ``CHUNK`` tokens do the same with it, until one
node holds all. Its last tokens are cut into sequences of powers of two, which need no padding.

So no document is shuffled but for these rests, a task holds one chunk (or one longer document) at a time, and nothing
is padded.

Defined results
    null or empty text: the end id alone. Null ids and repeated rows: every row is packed as a document of its own.
    Ties: pieces of one length go by their place in the input, sequences of one cost by their number; levels are
    staged, so a rerun of a task changes nothing above it. Empty table: an empty result. Very long texts: cut into pieces of
    ``longest`` tokens. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tileflow.llm.scratch import stage

LENGTH = 4096
END_ID = 2
#: Cost of a token, and of a pair of tokens of one piece, for a model about 1,400 wide (6 * width tokens double the cost).
LINEAR, QUADRATIC = 1.0, 1 / 8192
#: Tokens that a task packs at a time.
CHUNK = 4096 * 1024
#: Words whose ids a task keeps, and the longest such word.
WORDS, WORD = 200_000, 40
#: A byte that no UTF-8 text has; the last letter up to which composition and lower case need no look at neighbours.
END, LATIN = b"\xff", "\u024f"
PROBE = "It's a TEST:\tcafé café 你好 ΟΔΟΣ   x　y \n\n 12345 foo_bar <|endoftext|> don't x \U0001f600 a b ́c"


def _merges(rules: dict) -> Callable[[bytes], list[int]] | None:
    """Bytes of a word (lower case, no white space) -> ids, by tiktoken's merges over the file's own vocabulary; None if the file is
    of another kind. The end of a word is a byte that no text has."""
    import tiktoken

    model, vocab = rules["model"], rules["model"].get("vocab") or {}
    ids = [vocab.get("".join(m), -1) for m in model.get("merges", [])]
    if model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or not ids or ids != sorted(ids) or ids[0] < 512:
        return None
    # fixed values: the byte alphabet of byte-level files maps printable bytes to themselves, others upwards from 256
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in kept)}
    special = {t["content"] for t in rules.get("added_tokens", [])}
    raw = lambda t: bytes(byte_of[c] for c in t.removesuffix("</w>")) + (END if t.endswith("</w>") else b"")
    words = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks={raw(t): i for t, i in vocab.items() if t not in special}, special_tokens={})
    return lambda word: words._encode_single_piece(word + END)


@cache
def word_encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizer file at ``path``, special tokens in a text being ordinary text.

    If the file's rules drop white space and never look across it, words between white space are encoded each for itself and
    their ids kept, as many words of a corpus come again. Words of Latin letters are split by the file's own pattern and merged by
    tiktoken, others by tokenizers itself. This is checked on a probe text; a file of other rules, or one that differs, is run by
    tokenizers as a whole.
    """
    import regex
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    lower = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if not (lower and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[-1].get("add_prefix_space") is False):
        return plain
    parts = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
    merge = _merges(rules)
    known: dict[bytes, list[int]] = {}

    def word(raw: bytes) -> list[int]:
        w = raw.decode()
        if merge is None or not w.isascii() and max(w) > LATIN:
            return plain(w)
        return [i for p in parts.findall(w.lower()) for i in merge(p.encode())]

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for w in text.encode().split():  # at ASCII white space
            ids = known.get(w)
            if ids is None:
                ids = word(w)
                if len(w) <= WORD:
                    if len(known) >= WORDS:
                        known.clear()
                    known[w] = ids
            out += ids
        return out

    return encode if encode(PROBE) == plain(PROBE) else plain


def balanced(lengths: list[int], length: int, longest: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Documents by their lengths -> ([(document, start, length, sequence, offset)] that fill sequences, [(document, start, length)] left)."""
    items = [(-min(longest, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, longest)]
    heapq.heapify(items)
    open_ = [(0.0, q) for q in range(sum(lengths) // length)]  # a heap as it is
    used, placed = [0] * len(open_), []
    while open_:
        size, d, s = heapq.heappop(items)
        cost, q = open_[0]
        n = min(-size, length - used[q])
        placed.append((d, s, n, q, used[q]))
        used[q] += n
        if used[q] < length:
            heapq.heapreplace(open_, (cost + linear * n + quadratic * n * n, q))
        else:
            heapq.heappop(open_)
        if n < -size:
            heapq.heappush(items, (size + n, d, s + n))
    return placed, [(d, s, -size) for size, d, s in sorted(items)]


def in_powers_of_two(rest: list[tuple[int, int, int]], first: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length) of less than a sequence -> pieces of sequences of 2^b tokens, from number ``first``."""
    total, out = sum(n for _, _, n in rest), []
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    q, at = 0, 0
    for d, s, n in rest:
        while n:
            took = min(n, sizes[q] - at)
            out.append((d, s, took, first + q, at))
            s, n, at = s + took, n - took, at + took
            if at == sizes[q]:
                q, at = q + 1, 0
    return out


def packed_by_cost(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, longest: int | None = None, end_id: int = END_ID,
    linear: float = LINEAR, quadratic: float = QUADRATIC, chunk: int = CHUNK, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids: little-endian uint32]) of all pieces."""
    longest = min(longest or length, length)
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")]).schema
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def packed(keys: list[pa.Array], held: list[tuple[np.ndarray, int, int]], first: int, last: bool) -> tuple[pa.RecordBatch, int]:
        """One chunk: ids, start and length of its documents (or pieces of documents), in the order of keys."""
        placed, rest = balanced([len(i) for i, _, _ in held], length, longest, linear, quadratic)
        opened = sum(len(i) for i, _, _ in held) // length
        if last:
            placed, rest = placed + in_powers_of_two(rest, opened), []
        out: list[list] = [[] for _ in fields.split(", ")]
        for d, s, n, q, at in [*placed, *[(d, s, n, None, None) for d, s, n in rest]]:
            ids, start, whole = held[d]
            part = ids[s : s + n].tobytes()
            values = (start + s, n, zlib.crc32(part), whole, None if q is None else first + q, at, part if with_ids or q is None else None)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        order = pa.array([d for d, *_ in placed] + [d for d, *_ in rest], pa.int64())
        columns = [pa.concat_arrays(keys).take(order), *[pa.array(x, t) for x, t in zip(out, arrow.types[1:], strict=True)]]
        return pa.RecordBatch.from_arrays(columns, schema=arrow), first + opened + 64

    def chunks(found: Iterator[tuple[pa.Array, list[tuple[np.ndarray, int, int]]]], level: int, last: bool) -> Iterator[pa.RecordBatch]:
        first = level << 58 | TaskContext.get().partitionId() << 27
        keys, held, tokens = [], [], 0
        for key, documents in found:
            keys.append(key)
            held += documents
            tokens += sum(len(i) for i, _, _ in documents)
            if tokens >= chunk and not last:
                out, first = packed(keys, held, first, False)
                yield from _slices(out)
                keys, held, tokens = [], [], 0
        if held:
            yield from _slices(packed(keys, held, first, last)[0])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)

        def found():
            for b in batches:
                for s in range(0, b.num_rows, 100):
                    part, documents = b.slice(s, 100), []
                    for text in part.column(1).to_pylist():
                        ids = np.array([*encode(text), end_id] if text else [end_id], "<u4")
                        documents.append((ids, 0, len(ids)))
                    yield part.column(0), documents

        yield from chunks(found(), 0, False)

    def node(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = ((b.column(0), [(np.frombuffer(i, "<u4"), s, n) for i, s, n in zip(*[b.column(c).to_pylist() for c in ("ids", "start", "doc_tokens")], strict=True)]) for b in batches)
            yield from chunks(found, level, last)

        return run

    level = stage(rows.mapInArrow(leaf, schema), "cost-level")
    finished, turn = [level.where("sequence_id IS NOT NULL")], 0
    while tokens := level.where("sequence_id IS NULL").agg(F.sum("length")).first()[0]:
        nodes, turn = -(-tokens // chunk), turn + 1
        left = level.where("sequence_id IS NULL").withColumn("row", F.monotonically_increasing_id())
        left = left.repartition(nodes, F.xxhash64("row", F.lit(turn))).drop("row") if nodes > 1 else left.coalesce(1)
        level = stage(left.mapInArrow(node(turn, nodes == 1), schema), "cost-level")
        finished.append(level.where("sequence_id IS NOT NULL"))
    out = reduce(DataFrame.unionAll, finished)
    return out if with_ids else out.drop("ids")


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for s in range(0, rows.num_rows, 10_000):
        yield rows.slice(s, 10_000)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cost_packing_report(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = packed_by_cost(docs, tokenizer or default_tokenizer(), id_col=id_col, text_col=text_col)
    return out.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """(sequence_id, cost, ids: little-endian uint32, doc_ids, offsets): the sequences themselves, in the order of offsets."""
    parts = packed_by_cost(docs, tokenizer or default_tokenizer(), id_col=id_col, text_col=text_col, length=length, linear=linear, quadratic=quadratic, with_ids=True)
    rows = F.sort_array(F.collect_list(F.struct("offset", "length", "ids", F.col("doc_id").alias("doc"))))
    found = parts.groupBy("sequence_id").agg(rows.alias("r"))
    cost = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.lit(linear) * x["length"] + F.lit(quadratic) * x["length"] * x["length"])
    return found.select("sequence_id", cost.alias("cost"), F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("r.doc").alias("doc_ids"), F.col("r.offset").alias("offsets"))
