"""Tile stores: seven operations behind a URI, on tables of requests and of metatiles.

read, stat and storage_id take requests(style, z, x, y) and add columns; write, delete and expire take
metatiles(style, z, mx, my[, blob, mtime]); close has nothing to do. File stores are real ``.meta`` trees,
of which only the files asked for are opened, or packed, the same files in archives; key-value stores are log-structured tables, to which a write, a delete or an
expiry adds a run of rows. A proxy store answers
from a table of responses, a composite store from two stores. Neither takes writes.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tileflow.constants import META_HEADER
from tileflow.functions import address as A
from tileflow.sources import archives, files, metatile, segments, shared

META_SCHEMA = "path string, mtime timestamp_ntz, size long, blob binary"
SCHEMES = ("rados://", "memcached://", "ro_http_proxy://", "composite:{", "null://")


def backend(uri: Column) -> Column:
    """Kind of store a URI names; null if none. Whether a path is a directory is for open_store to find."""
    return F.when(uri.startswith("/"), "file").when(uri.startswith("rados://"), "rados").when(uri.startswith("memcached://"), "memcached").when(uri.startswith("ro_http_proxy://"), "proxy").when(uri.startswith("composite:{"), "composite").when(uri.startswith("null://"), "null")


def parse_uri(uri: Column) -> dict[str, Column]:
    """Parts of a store URI: pool and configuration, server options, and the two halves of a composite."""
    two = r"^composite:\{([^,]*),(.*?)\}\{([^,]*),(.*)\}$"
    part = lambda p, i: F.when(F.regexp_like(uri, F.lit(p)), F.regexp_extract(uri, p, i))
    rados, mem = r"^rados://([^/]*)(.*)$", r"^memcached://(.*)$"
    server = part(mem, 1)
    return {
        "pool": part(rados, 1), "conf": part(rados, 2), "server": F.when(server == "", "--server=localhost").otherwise(F.concat(F.lit("--server="), server)),
        "style_1": part(two, 1), "uri_1": part(two, 2), "style_2": part(two, 3), "uri_2": part(two, 4),
    }


class ReadOnlyStore(RuntimeError):
    """Raised on writes to a store that takes none."""


@dataclass(frozen=True)
class Store:
    """What all kinds share; ``kind`` is the scheme's name."""

    kind = ""
    read_only = False

    def stat(self, requests: DataFrame) -> DataFrame:
        """requests with size (-1 if missing), mtime and expired (as far as the store itself says)."""
        raise NotImplementedError

    def read(self, requests: DataFrame) -> DataFrame:
        """requests with status (bytes read, or a negative code), data and compressed."""
        raise NotImplementedError

    def storage_id(self, requests: DataFrame) -> DataFrame:
        """requests with storage_id, the place of the tile in words."""
        return requests.withColumn("storage_id", self.place())

    def place(self) -> Column:
        raise NotImplementedError

    def write(self, metatiles: DataFrame) -> None:
        raise ReadOnlyStore(self.kind)

    def delete(self, metatiles: DataFrame) -> None:
        raise ReadOnlyStore(self.kind)

    def expire(self, metatiles: DataFrame) -> None:
        raise ReadOnlyStore(self.kind)

    def close(self) -> None:
        """Stores hold nothing open between operations."""


_ADDRESS = ("style", "z", "mx", "my")


def _met(requests: DataFrame) -> tuple[Column, Column]:
    """Origin of the metatile, whether rows are tiles or metatiles."""
    x, y = ("x", "y") if "x" in requests.columns else ("mx", "my")
    return A.metatile_origin(F.col(x)), A.metatile_origin(F.col(y))


def tiles_of(requests: DataFrame, stored: DataFrame, key: Column) -> DataFrame:
    """requests with the tile of the stored(stored_key, blob) metatile whose key they have. A metatile is taken apart once
    for each slot asked for, so blobs meet the distinct tiles and not every request, and a tile that a third of all
    requests ask for is joined to them in as many tasks as they need."""
    r = requests.withColumn("tile_key", key).withColumn("tile_slot", A.metatile_slot(F.col("x"), F.col("y")).cast("int"))
    asked = r.groupBy("tile_key", "tile_slot").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    found = metatile.read_tiles(asked.join(stored, F.col("tile_key") == F.col("stored_key"), "left"))
    found = shared.staged(found.select(F.col("tile_key").alias("k"), F.col("tile_slot").alias("s"), "status", "data", "compressed"), "tiles")
    return r.join(found, (F.col("tile_key") == F.col("k")) & (F.col("tile_slot") == F.col("s"))).drop("tile_key", "tile_slot", "k", "s")


@dataclass(frozen=True)
class FileStore(Store):
    """A tree of ``.meta`` files, or ``packed``: the same files in zip archives, for more metatiles than a file system has inodes for."""

    root: str
    now: str | None = None
    packed: bool = False
    kind = "file"

    def path(self, rows: DataFrame) -> Column:
        return A.hashed_path(F.lit(self.root), F.col("style"), F.col("z"), *_met(rows))

    def stat(self, requests: DataFrame) -> DataFrame:
        """Expired is what is older than the last import of its style (see ``files.IMPORTED``), without one than three days ago,
        and what is missing."""
        r = requests.withColumn("file_key", self.path(requests))  # a column: a join on an expression has it anew in each comparison of its sort
        asked = r.select(F.col("file_key").alias("path"), "style").distinct()
        found = shared.staged(files.stats(asked, self.root, self.packed).withColumnRenamed("path", "file_path"), "stats")
        now = F.expr("localtimestamp()") if self.now is None else F.expr(f"TIMESTAMP_NTZ '{self.now}'")
        out = r.join(found, F.col("file_key") == F.col("file_path"), "left")
        expired = F.coalesce(F.col("mtime") < F.coalesce("imported", now - F.expr("INTERVAL 3 DAYS")), F.lit(True))
        return out.withColumn("size", F.coalesce("file_size", F.lit(-1).cast("long"))).withColumn("expired", expired).drop("file_key", "file_path", "file_size", "imported")

    def read(self, requests: DataFrame) -> DataFrame:
        """Every file asked for is opened once, for all its tiles asked for; a tile that a third of all requests ask for is joined
        to them in as many tasks as they need."""
        r = requests.withColumn("tile_key", self.path(requests)).withColumn("tile_slot", A.metatile_slot(F.col("x"), F.col("y")).cast("int"))
        asked = r.groupBy(F.col("tile_key").alias("path")).agg(F.sort_array(F.collect_set("tile_slot")).alias("slots"))  # at most 64
        found = shared.staged(files.tiles(asked, self.packed).withColumnsRenamed({"path": "k", "slot": "s"}), "tiles")
        return r.join(found, (F.col("tile_key") == F.col("k")) & (F.col("tile_slot") == F.col("s"))).drop("tile_key", "tile_slot", "k", "s")

    def place(self) -> Column:
        return F.concat(F.lit("file://"), A.hashed_path(F.lit(self.root), F.col("style"), F.col("z"), F.col("x"), F.col("y")))

    def _apply(self, metatiles: DataFrame, operation: str) -> None:
        metatiles.sparkSession.dataSource.register(MetaFiles)
        path = F.col("path") if "path" in metatiles.columns else self.path(metatiles)
        extra = [c if c in metatiles.columns else F.lit(None).cast(t).alias(c) for c, t in (("mtime", "timestamp_ntz"), ("blob", "binary"))]
        rows = metatiles.select(path.alias("path"), extra[0], F.lit(0).cast("long").alias("size"), extra[1])
        rows = rows if operation == "write" else rows.dropDuplicates(["path"])
        if self.packed:  # an archive in one task, its rows side by side, of a file written twice the later first
            at = archives.archive(F.col("path"))
            rows = rows.withColumn("archive", at).repartition("archive").sortWithinPartitions("archive", "path", F.desc_nulls_first("mtime")).drop("archive")
        rows.write.format("metatiles").option("root", self.root).option("operation", operation).option("packed", self.packed).mode("append").save()

    def write(self, metatiles: DataFrame) -> None:
        self._apply(metatiles, "write")

    def delete(self, metatiles: DataFrame) -> None:
        self._apply(metatiles, "delete")

    def expire(self, metatiles: DataFrame) -> None:
        self._apply(metatiles, "expire")


@dataclass(frozen=True)
class TableStore(Store):
    """A key-value store of either key layout as a log-structured table below ``table``. ``head`` repeats the index of the
    container, so that stat reads no contents. An expiry is a new row that names the old contents."""

    layout: str  # memcached or rados
    table: str
    pool: str = "tiles"

    @property
    def kind(self) -> str:  # type: ignore[override]
        return self.layout

    @property
    def runs(self) -> segments.Segments:
        return segments.Segments(self.table)

    def key(self, rows: DataFrame) -> Column:
        return A.store_keys(F.col("style"), F.col("z"), *_met(rows), F.lit(""))[f"{self.layout}_key"]

    def latest(self, spark: SparkSession, *columns: str) -> DataFrame:
        """What is stored: (key, columns)."""
        return self.runs.latest(spark, *columns)

    def _known(self, requests: DataFrame, *columns: str) -> DataFrame:
        return self.runs.latest(requests.sparkSession, *columns, keys=requests.select(self.key(requests).alias("key")))

    def stat(self, requests: DataFrame) -> DataFrame:
        """The size is the tile's own entry in the container; a missing tile is not expired."""
        known = shared.staged(self._known(requests, "mtime", "expired", "head"), "known")
        known = known.withColumnRenamed("key", "known_key").withColumnRenamed("expired", "marked")
        found = requests.join(known, self.key(requests) == F.col("known_key"), "left")
        _, size = metatile.entry(F.col("head"), A.metatile_slot(F.col("x"), F.col("y")))
        return found.withColumn("size", F.when(F.col("known_key").isNull(), -1).otherwise(size).cast("long")).withColumn("expired", F.coalesce("marked", F.lit(False))).drop("known_key", "marked", "head")

    def read(self, requests: DataFrame) -> DataFrame:
        """Every metatile asked for is read once, for all its tiles asked for, as in a file store."""
        r = requests.withColumn("tile_key", self.key(requests)).withColumn("tile_slot", A.metatile_slot(F.col("x"), F.col("y")).cast("int"))
        asked = r.groupBy(F.col("tile_key").alias("key")).agg(F.sort_array(F.collect_set("tile_slot")).alias("slots"))  # at most 64
        asked = shared.staged(asked, "asked")
        runs = self.runs
        found = runs.tiles(runs.latest(requests.sparkSession, "blob_run", keys=asked).join(asked, "key"))
        found = shared.staged(found.withColumnsRenamed({"key": "k", "slot": "s"}), "tiles")
        out = r.join(found, (F.col("tile_key") == F.col("k")) & (F.col("tile_slot") == F.col("s")), "left")
        return out.withColumn("status", F.coalesce("status", F.lit(-1))).drop("tile_key", "tile_slot", "k", "s")

    def place(self) -> Column:
        if self.layout == "rados":
            return F.concat(F.lit(f"rados://{self.pool}/"), A.store_keys(F.col("style"), F.col("z"), F.col("x"), F.col("y"), F.lit(""))["rados_key"])
        s = lambda c: F.col(c).cast("string")
        return F.concat(F.lit("memcached:///"), F.concat_ws("/", F.col("style"), s("x"), s("y"), s("z")), F.lit(".meta"))

    def write(self, metatiles: DataFrame) -> None:
        """The state written with a metatile is that of a fresh one."""
        head = F.substring(F.col("blob"), 1, META_HEADER) if "blob" in metatiles.columns else F.lit(None).cast("binary")
        have = [c for c in (*_ADDRESS, "mtime", "blob") if c in metatiles.columns]
        rows = metatiles.select(self.key(metatiles).alias("key"), *have, head.alias("head"), F.lit(False).alias("expired"), F.lit(False).alias("deleted"))
        self.runs.add(rows)

    def delete(self, metatiles: DataFrame) -> None:
        gone = metatiles.select(*_ADDRESS).distinct()
        self.runs.add(gone.select(self.key(gone).alias("key"), *_ADDRESS, F.lit(True).alias("deleted")))

    def expire(self, metatiles: DataFrame) -> None:
        """What is stored is marked; what is not stays missing."""
        rows = self._known(metatiles, *_ADDRESS, "mtime", "head", "blob_run")
        self.runs.add(rows.withColumn("expired", F.lit(True)).withColumn("deleted", F.lit(False)))

    def close(self) -> None:
        """Between operations, neighbouring runs are merged where enough of a level stand together."""
        if spark := SparkSession.getActiveSession():
            self.runs.merge(spark)


@dataclass(frozen=True)
class NullStore(Store):
    """Nothing is found in it, and whatever is done to it succeeds."""

    kind = "null"

    def stat(self, requests: DataFrame) -> DataFrame:
        return requests.withColumns({"size": F.lit(-1).cast("long"), "mtime": F.lit(None).cast("timestamp_ntz"), "expired": F.lit(True)})

    def read(self, requests: DataFrame) -> DataFrame:
        return requests.withColumns({"status": F.lit(-1), "data": F.lit(None).cast("binary"), "compressed": F.lit(False)})

    def place(self) -> Column:
        return F.lit("null://")

    def write(self, metatiles: DataFrame) -> None:
        metatiles.write.format("noop").mode("overwrite").save()

    delete = expire = write


@dataclass(frozen=True)
class ProxyStore(Store):
    """A read-only proxy by its responses(path, http, last_modified, body): 200, or else the tile is missing. Nothing it
    serves is expired."""

    base: str
    responses: DataFrame | None = None
    kind = "proxy"
    read_only = True

    def _answers(self, requests: DataFrame) -> DataFrame:
        if self.responses is None:
            raise RuntimeError(f"no table of responses of {self.base}")
        path = A.store_keys(F.col("style"), F.col("z"), F.col("x"), F.col("y"), F.lit(""))["proxy_path"]
        got = self.responses.where("http = 200").select(F.col("path").alias("got_path"), "last_modified", "body")
        return requests.join(got, F.concat(F.lit("/"), F.col("style"), F.lit("/"), path) == F.col("got_path"), "left").withColumn("found", F.col("got_path").isNotNull()).drop("got_path")

    def stat(self, requests: DataFrame) -> DataFrame:
        size = F.when(F.col("found"), F.length("body")).otherwise(-1).cast("long")
        return self._answers(requests).withColumns({"size": size, "mtime": F.col("last_modified"), "expired": F.lit(False)}).drop("last_modified", "body", "found")

    def read(self, requests: DataFrame) -> DataFrame:
        return self._answers(requests).withColumns({"status": F.when(F.col("found"), F.length("body")).otherwise(-1).cast("int"), "data": F.col("body"), "compressed": F.lit(False)}).drop("last_modified", "body", "found")

    def place(self) -> Column:
        return F.concat(F.lit(f"http://{self.base}/"), A.store_keys(F.col("style"), F.col("z"), F.col("x"), F.col("y"), F.lit(""))["proxy_path"])


@dataclass(frozen=True)
class CompositeStore(Store):
    """Tiles of one style drawn over those of another: both must be there to read, the state is the lower one's alone."""

    lower: Store | None
    lower_style: str
    upper: Store | None
    upper_style: str
    kind = "composite"
    read_only = True

    def stat(self, requests: DataFrame) -> DataFrame:
        return self.lower.stat(requests.withColumn("style", F.lit(self.lower_style)))

    def read(self, requests: DataFrame) -> DataFrame:
        """data and over: the tiles of both styles, for the renderer to blend; status is the lower one's, or what failed."""
        below = self.lower.read(requests.withColumn("style", F.lit(self.lower_style)))
        below = below.withColumnsRenamed({"status": "lower_status", "data": "lower_data"}).drop("compressed")
        both = self.upper.read(below.withColumn("style", F.lit(self.upper_style))).withColumnRenamed("data", "over")
        status = F.when(F.col("lower_status") < 0, F.col("lower_status")).when(F.col("status") < 0, F.col("status")).otherwise(F.col("lower_status"))
        return both.withColumn("status", status).withColumnRenamed("lower_data", "data").drop("lower_status")

    def place(self) -> Column:
        return F.lit("Coposite tile")  # misspelled as users know it


def open_store(uri: str, tables: str = "", responses: DataFrame | None = None, packed: bool = False) -> Store | None:
    """The store of a URI, or None where the URI names none or its directory does not exist. Key-value stores keep their
    rows below the folder ``tables``, a proxy answers from ``responses``, a directory's files may be ``packed``."""
    if uri.startswith("/"):
        return FileStore(uri, packed=packed) if os.path.isdir(uri) else None
    for scheme, kind in zip(SCHEMES, ("rados", "memcached", "proxy", "composite", "null"), strict=True):
        if uri.startswith(scheme):
            rest = uri[len(scheme) :]
            if kind == "null":
                return NullStore()
            if kind == "proxy":
                return ProxyStore(rest, responses)
            if kind == "composite":
                m = re.fullmatch(r"([^,]*),(.*?)\}\{([^,]*),(.*)\}", rest)
                return CompositeStore(open_store(m[2], tables, responses), m[1], open_store(m[4], tables, responses), m[3]) if m else None
            return TableStore(kind, f"{tables}/{kind}-{re.sub('[^A-Za-z0-9]+', '-', rest) or 'localhost'}", rest.split("/")[0])
    return None


class MetaFiles(DataSource):
    """``.meta`` files below a root that all nodes mount: the second-level hash directories are dealt to partitions to read, temporary
    file and rename to write. Options: root, styles, minzoom, maxzoom; contents (false: no blobs are read); operation
    (write, delete, expire); packed (true: the files lie in archives, dealt by their numbers)."""

    @classmethod
    def name(cls) -> str:
        return "metatiles"

    def schema(self) -> str:
        return META_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MetaReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MetaWriter(self.options)


#: Partitions of a store that is listed; rows and bytes of blobs that they hand on at a time.
SHARES, ROWS, BATCH = 64, 10_000, 16 << 20


class MetaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.styles = options["root"], [s for s in options.get("styles", "").split(",") if s]
        self.zooms = range(int(options.get("minzoom", 0)), int(options.get("maxzoom", 20)) + 1)
        self.contents = options.get("contents", "true") == "true"
        self.packed = options.get("packed", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Shares of the second-level hash folders of all styles and zooms, by name: they are listed by the tasks."""
        return [InputPartition(i) for i in range(archives.SHELVES if self.packed else SHARES)]

    def _tops(self) -> list[str]:
        styles = self.styles or sorted(d.name for d in os.scandir(self.root) if d.is_dir())
        return [f"{self.root}/{s}/{z}" for s in styles for z in self.zooms]

    def _folders(self, share: int) -> Iterator[str]:
        for top in self._tops():
            for first in _below(top):
                for second in _below(first):
                    if zlib.crc32(second.encode()) % SHARES == share:
                        yield second

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us")), ("size", pa.int64()), ("blob", pa.binary())])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for row in (self._packed if self.packed else self._tree)(partition.value):
            rows.append(row)
            held += len(row[3] or b"")
            if len(rows) >= ROWS or held >= BATCH:
                yield batch()
                rows, held = [], 0
        yield batch()

    def _packed(self, n: int) -> Iterator[tuple]:
        for top in self._tops():
            if found := archives.opened(archives.shelf(top, n)):
                with found:
                    for name, info in found.members.items():
                        yield f"{top}/{name}", int(archives.changed_at(info) / 1e6) * 1_000_000, info.file_size, found.contents(info) if self.contents else None

    def _tree(self, share: int) -> Iterator[tuple]:
        for top in self._folders(share):
            folders = [top]
            while folders:  # as os.walk, without a look at each folder for links: a file of a high zoom has most of its folders to itself
                with os.scandir(folders.pop()) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            folders.append(e.path)
                        elif e.name.endswith(".meta"):
                            blob = None
                            if self.contents:
                                with open(e.path, "rb") as f:
                                    blob = f.read()
                            st = e.stat()
                            yield e.path, int(st.st_mtime) * 1_000_000, st.st_size, blob


def _below(folder: str) -> list[str]:
    """Folders in a folder; none if it does not exist."""
    try:
        return sorted(e.path for e in os.scandir(folder) if e.is_dir())
    except FileNotFoundError:
        return []


class MetaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.operation = options["root"], options.get("operation", "write")
        self.packed = options.get("packed", "false").lower() == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        if self.packed:
            for at, rows in groupby(self._placed(batches), lambda row: row[0]):
                archives.change(at, (row[1:] for row in rows), self.operation)
            return WriterCommitMessage()
        suffix = uuid.uuid4().hex
        for path, mtime, blob in self._rows(batches):
            if self.operation == "write":
                self._write(path, mtime, blob.as_py(), suffix)
            elif self.operation == "delete":
                with contextlib.suppress(FileNotFoundError):  # gone already, maybe by another run of this task
                    os.remove(path)
            else:
                self._expire(path)
        return WriterCommitMessage()

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, mtime, blob in zip(b.column("path").to_pylist(), b.column("mtime").to_pylist(), b.column("blob"), strict=True):
                if not path.startswith(f"{self.root}/") or ".." in path:
                    raise ValueError(f"{path} is outside the store")
                yield path, mtime, blob

    def _placed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows by archive: (archive, name, microseconds, contents)."""
        since = dt.datetime(1970, 1, 1)
        for path, mtime, blob in self._rows(batches):
            yield *archives.place(path), None if mtime is None else (mtime - since) // dt.timedelta(microseconds=1), blob.as_py()

    def _write(self, path: str, mtime: dt.datetime | None, blob: bytes, suffix: str) -> None:
        temporary = f"{path}.{suffix}"
        try:
            f = open(temporary, "wb")  # noqa: SIM115
        except FileNotFoundError:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            f = open(temporary, "wb")  # noqa: SIM115
        with f:
            f.write(blob)
        if mtime is not None:
            at = mtime.replace(tzinfo=dt.UTC).timestamp()
            os.utime(temporary, (at, at))
        os.replace(temporary, path)

    def _expire(self, path: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            at = os.stat(path).st_mtime
            if (old := archives.aged(at)) != at:
                os.utime(path, (old, old))


def scan(spark: SparkSession, root: str, styles: list[str], min_zoom: int, max_zoom: int, packed: bool = False) -> DataFrame:
    """(path, mtime, size) of the metatiles of a file store, listed by tasks; contents are not read.

    Zooms are pruned by naming their folders; bad paths are kept out by the address they parse to.
    """
    return files.listed(spark, [f"{root}/{s}/{z}" for s in styles for z in range(min_zoom, max_zoom + 1)], packed)


def parsed(scanned: DataFrame, root: str) -> DataFrame:
    """Scanned files with style, z, x, y; files whose path is no address are left out."""
    valid = F.filter(A.parsed_path(root, F.col("path")), lambda p: p["code"] == 0)
    return scanned.select("*", F.inline(valid)).drop("code")


def expired_time(mtime: Column) -> Column:
    """What expiring a file does to its time: back by 20 years, unless it is so old already."""
    return F.when(F.year(mtime) > 2005, mtime - F.expr("INTERVAL 20 YEARS")).otherwise(mtime)
