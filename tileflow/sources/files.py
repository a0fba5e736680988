"""Files of a metatile store, opened and listed by tasks.

Reading is by key: the distinct paths asked for are dealt to tasks, and a task opens those files and no other. Of a file it
reads the index and the tiles asked for. Listing goes from the folders of styles and zooms down by two levels of hash
folders, each level dealt to tasks anew, before whole trees are walked; the driver sees the folders of zooms alone.
The root is a folder that all nodes mount. In a packed store the files lie in archives (see ``archives``): tasks get whole archives, and
open each once.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import itertools
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.constants import META_HEADER
from tileflow.sources import archives, metatile

#: A file's time says when the data of its style, or of all styles of the store, were last imported.
IMPORTED = "planet-import-complete"
#: Bytes of tiles that a task hands on at a time.
BATCH = 16 << 20


def _time(seconds: float) -> dt.datetime:
    return dt.datetime.fromtimestamp(int(seconds), dt.UTC).replace(tzinfo=None)


def _dealt(asked: DataFrame) -> DataFrame:
    """Rows with paths, those of an archive in one task and side by side."""
    return asked.withColumn("archive", archives.archive(F.col("path"))).repartition("archive").sortWithinPartitions("archive").drop("archive")


def _packed(rows: Iterable[tuple]) -> Iterator[tuple[archives.Archive | None, str, tuple]]:
    """rows(path, ..) with the opened archive and the name in it; an archive is opened once for the rows that stand side by side."""
    for at, group in itertools.groupby(rows, lambda row: archives.place(row[0])[0]):
        found = archives.opened(at)
        with found or contextlib.nullcontext():
            for row in group:
                yield found, archives.place(row[0])[1], row


def _cut(read: Callable[[int, int], bytes], length: int, path: str, slots: list[int]) -> Iterator[tuple]:
    """Tiles of a container by read(offset, n): its index and the tiles asked for."""
    head = read(0, min(META_HEADER, length))
    for slot in slots:
        at, size = metatile.locate(head, length, slot)
        yield path, slot, size, read(at, size) if size >= 0 else None, head[:4] == b"METZ"


def tiles(asked: DataFrame, packed: bool = False) -> DataFrame:
    """asked(path, slots: array<int>) -> (path, slot, status, data, compressed) for every slot asked for."""
    schema = pa.schema([("path", pa.string()), ("slot", pa.int32()), ("status", pa.int32()), ("data", pa.binary()), ("compressed", pa.bool_())])

    def missing(path: str, slots: list[int]) -> Iterator[tuple]:
        for slot in slots:
            yield path, slot, -1, None, None

    def of_tree(wanted: Iterable[tuple]) -> Iterator[Iterator[tuple]]:
        for path, slots in wanted:
            try:
                with open(path, "rb", buffering=0) as f:
                    yield _cut(lambda at, n, fd=f.fileno(): os.pread(fd, n, at), os.fstat(f.fileno()).st_size, path, slots)
            except FileNotFoundError:
                yield missing(path, slots)

    def of_archives(wanted: Iterable[tuple]) -> Iterator[Iterator[tuple]]:
        for found, name, (path, slots) in _packed(wanted):
            info = found and found.members.get(name)
            if info is None:
                yield missing(path, slots)
            else:
                yield _cut(lambda at, n, start=found.start(info), found=found: found.read(start + at, n), info.file_size, path, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for one in (of_archives if packed else of_tree)(_rows(batches)):
            for row in one:
                rows.append(row)
                size += len(row[3] or b"")
            if size >= BATCH or len(rows) >= 10_000:
                yield _batch(rows, schema)
                rows, size = [], 0
        yield _batch(rows, schema)

    asked = asked.select("path", "slots")
    return (_dealt(asked) if packed else asked).mapInArrow(run, "path string, slot int, status int, data binary, compressed boolean")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def stats(asked: DataFrame, root: str, packed: bool = False) -> DataFrame:
    """asked(path, style) -> (path, file_size, mtime, imported: time of the style's last import) of the files that exist."""
    schema = pa.schema([("path", pa.string()), ("file_size", pa.int64()), ("mtime", pa.timestamp("us")), ("imported", pa.timestamp("us"))])

    def of_tree(wanted: Iterable[tuple]) -> Iterator[tuple]:
        for path, style in wanted:
            if st := _stat(path):
                yield path, style, st.st_size, _time(st.st_mtime)

    def of_archives(wanted: Iterable[tuple]) -> Iterator[tuple]:
        for found, name, (path, style) in _packed(wanted):
            if info := found and found.members.get(name):
                yield path, style, info.file_size, _time(archives.changed_at(info) / 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        imported: dict[str | None, dt.datetime | None] = {}
        found = (of_archives if packed else of_tree)(_rows(batches))
        while rows := list(itertools.islice(found, 10_000)):
            for style in {r[1] for r in rows} - imported.keys():
                marks = [m for m in (f"{root}/{style}/{IMPORTED}", f"{root}/{IMPORTED}") if os.path.exists(m)]
                imported[style] = _time(os.stat(marks[0]).st_mtime) if marks else None
            yield _batch([(path, size, at, imported[style]) for path, style, size, at in rows], schema)

    asked = asked.select("path", "style")
    return (_dealt(asked) if packed else asked).mapInArrow(run, "path string, file_size long, mtime timestamp_ntz, imported timestamp_ntz")


def listed(spark: SparkSession, folders: list[str], packed: bool = False) -> DataFrame:
    """(path, mtime, size) of the ``.meta`` files below folders of zooms, as many as styles and zooms."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [e.path for top in b.column(0).to_pylist() if os.path.isdir(top) for e in os.scandir(top) if e.is_dir()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["folder"])

    schema = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us")), ("size", pa.int64())])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for top in b.column(0).to_pylist():
                for folder, _, names in os.walk(top):
                    rows = [(f"{folder}/{n}", st) for n in names if n.endswith(".meta") and (st := _stat(f"{folder}/{n}"))]
                    yield _batch([(p, _time(st.st_mtime), st.st_size) for p, st in rows], schema)

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, n in _rows(batches):
            if found := archives.opened(archives.shelf(top, n)):
                with found:
                    yield _batch([(f"{top}/{name}", _time(archives.changed_at(i) / 1e6), i.file_size) for name, i in found.members.items()], schema)

    level = spark.createDataFrame([(f,) for f in folders], "folder string")
    if packed:
        level = level.select("folder", F.explode(F.sequence(F.lit(0), F.lit(archives.SHELVES - 1))).alias("n")).repartition(parts, F.xxhash64("folder", "n"))
        return level.mapInArrow(archived, "path string, mtime timestamp_ntz, size long")
    for _ in range(2):
        level = level.mapInArrow(below, "folder string").repartition(parts, F.xxhash64("folder"))
    return level.mapInArrow(walked, "path string, mtime timestamp_ntz, size long")


def mark_import(root: str, style: str | None, at: float) -> None:
    """Note the time (in seconds) of the last import of a style, or of all."""
    path = f"{root}/{style}/{IMPORTED}" if style else f"{root}/{IMPORTED}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w"):
        os.utime(path, (at, at))


def _stat(path: str) -> os.stat_result | None:
    try:
        return os.stat(path)
    except FileNotFoundError:  # deleted since it was listed
        return None
