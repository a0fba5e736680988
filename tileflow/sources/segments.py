"""A log-structured key-value table: sorted runs of rows, a manifest that names them, merges that keep them few.

A write adds a run; nothing is rewritten. A run has an index (a row a key, without contents) and, if it brought contents, blobs;
both are Parquet, in folders by ``bucket`` of the key's hash. What counts of a key is its row in the newest run that has
it, so reading shuffles keys and small columns; a row names the run that holds its blob, and blobs are read by the tasks to which the
wanted keys of a bucket are dealt, a range of sorted keys at a time, or the tiles asked for are taken out there.

The manifest is a numbered file of names of runs, oldest first. A change writes its files, then links the next number, which fails if
another writer was first: then it is tried again on top of that one. So order is the manifest's, whatever clocks say, a change
is there as a whole or not at all, and a reader keeps the runs it began with. ``merge`` joins neighbouring runs of one level,
``fan`` at a time, into one of the next, index only; ``compact`` joins all, drops what is deleted and copies the blobs that are
left; ``vacuum`` removes files no manifest in use names.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.constants import META_HEADER
from tileflow.sources import metatile, shared

INDEX = "key string, style string, z int, mx long, my long, mtime timestamp_ntz, expired boolean, deleted boolean, head binary, blob_run string"
#: Folders of a table by hash of the key, fixed when it is made (more suit large ones); runs of a level that are merged at a time.
BUCKETS, FAN = 16, 4
#: Bytes of blobs that a task hands on at a time.
BATCH = 16 << 20


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


class Segments:
    """The runs of one table below a folder that all nodes mount."""

    def __init__(self, folder: str, buckets: int = BUCKETS, fan: int = FAN):
        self.folder, self.fan = folder, fan
        self.buckets = json.loads(self._manifest()[1] or "{}").get("buckets", buckets)

    def _manifest(self) -> tuple[int, str]:
        """(number, text) of the newest manifest; (0, '') if there is none."""
        top = f"{self.folder}/manifest"
        while True:
            numbers = [int(n) for n in os.listdir(top) if n.isdigit()] if os.path.isdir(top) else []
            if not numbers:
                return 0, ""
            try:
                with open(f"{top}/{max(numbers)}") as f:
                    return max(numbers), f.read()
            except FileNotFoundError:  # vacuumed meanwhile: there is a newer one
                continue

    def runs(self) -> list[dict]:
        """[{name, level, blobs}], oldest first."""
        return json.loads(self._manifest()[1] or '{"runs": []}')["runs"]

    def _commit(self, change) -> None:
        """change: runs -> runs, or None where the change no longer fits."""
        os.makedirs(f"{self.folder}/manifest", exist_ok=True)
        temporary = f"{self.folder}/manifest/tmp-{uuid.uuid4().hex}"
        while True:
            number, text = self._manifest()
            runs = change(json.loads(text or '{"runs": []}')["runs"])
            if runs is None:
                return
            with open(temporary, "w") as f:
                json.dump({"buckets": self.buckets, "runs": runs}, f)
            try:
                os.link(temporary, f"{self.folder}/manifest/{number + 1}")
                return
            except FileExistsError:
                continue
            finally:
                os.remove(temporary)

    def index(self, spark: SparkSession, runs: list[dict] | None = None) -> DataFrame:
        """All index rows of runs, with bucket and the number ``age`` of the run, newest highest."""
        runs = self.runs() if runs is None else runs
        schema = f"{INDEX}, bucket int"
        if not runs:
            return spark.createDataFrame([], schema).withColumn("age", F.lit(0))
        rows = [spark.read.schema(schema).parquet(f"file://{self.folder}/{r['name']}/index").withColumn("age", F.lit(i)) for i, r in enumerate(runs)]
        return reduce(DataFrame.unionAll, rows)

    def latest(self, spark: SparkSession, *columns: str, keys: DataFrame | None = None, runs: list[dict] | None = None, gone: bool = False) -> DataFrame:
        """(key, columns) of the row that counts of each key, or of the keys(key) asked for; deleted ones only if ``gone``."""
        rows = self.index(spark, runs)
        if keys is not None:
            rows = rows.join(keys.select("key").distinct().withColumn("bucket", bucket(F.col("key"), self.buckets)), ["bucket", "key"], "left_semi")
        last = rows.groupBy("key").agg(F.max_by(F.struct(*dict.fromkeys(("deleted", *columns))), "age").alias("last"))
        out = last if gone else last.where("NOT last.deleted")
        return out.select("key", *[F.col(f"last.{c}").alias(c) for c in columns])

    def _found(self, wanted: DataFrame, rest: list[str], answer, result: pa.Schema, types: str) -> DataFrame:
        """wanted(key, blob_run, rest..) -> the rows that answer(blob, key, rest..) gives. Keys are dealt by run and bucket; tasks read the row
        groups that may hold them: they are sorted in files and in a task, so some thousand at a time lie close together."""
        folder, by = self.folder, ["blob_run", "bucket"]

        def of(run: str, n: int, keys: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            files = ds.dataset(f"{folder}/{run}/blobs/bucket={n}", format="parquet")
            key = ds.field("key")
            near = (key >= min(keys)) & (key <= max(keys))
            for b in files.scanner(columns=["key", "blob"], filter=near, batch_size=4096).to_batches():  # in a row group of 8 MB
                for k, blob in zip(b.column("key").to_pylist(), b.column("blob"), strict=True):
                    if k in keys:
                        got = answer(blob.as_buffer(), k, *keys[k])
                        rows += got
                        size += sum(len(x) for r in got for x in r if isinstance(x, bytes))
                        if size >= BATCH or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, size = [], 0
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), result, strict=True)], schema=result)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, keys = None, {}
            for b in batches:
                for r, n, k, *more in zip(*[b.column(c).to_pylist() for c in (*by, "key", *rest)], strict=True):
                    if (r, n) != now or len(keys) >= 10_000:
                        if keys:
                            yield from of(*now, keys)
                        now, keys = (r, n), {}
                    keys[k] = tuple(more)
            if keys:
                yield from of(*now, keys)

        parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = wanted.where("blob_run IS NOT NULL").select("blob_run", bucket(F.col("key"), self.buckets).alias("bucket"), "key", *rest).dropDuplicates(["blob_run", "key"])
        return dealt.repartition(parts, *by).sortWithinPartitions(*by, "key").mapInArrow(run, types)

    def blobs(self, wanted: DataFrame) -> DataFrame:
        """wanted(key, blob_run) -> (key, blob)."""
        schema = pa.schema([("key", pa.string()), ("blob", pa.binary())])
        return self._found(wanted, [], lambda blob, k: [(k, blob.to_pybytes())], schema, "key string, blob binary")

    def tiles(self, wanted: DataFrame) -> DataFrame:
        """wanted(key, blob_run, slots: array<int>) -> (key, slot, status, data, compressed) for every slot asked for: the tiles alone leave the task."""
        schema = pa.schema([("key", pa.string()), ("slot", pa.int32()), ("status", pa.int32()), ("data", pa.binary()), ("compressed", pa.bool_())])

        def answer(blob: pa.Buffer, k: str, slots: list[int]) -> list[tuple]:
            head, out = blob[:META_HEADER].to_pybytes(), []
            for slot in slots:
                at, size = metatile.locate(head, blob.size, slot)
                out.append((k, slot, size, blob[at : at + size].to_pybytes() if size >= 0 else None, head[:4] == b"METZ"))
            return out

        return self._found(wanted, ["slots"], answer, schema, "key string, slot int, status int, data binary, compressed boolean")

    def _write_index(self, rows: DataFrame, name: str) -> None:
        types = dict(x.split(" ") for x in INDEX.split(", "))
        out = rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])
        out = out.withColumn("bucket", bucket(F.col("key"), self.buckets))
        out.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"file://{self.folder}/{name}/index")

    def _write_blobs(self, rows: DataFrame, name: str) -> None:
        out = rows.select("key", "blob", bucket(F.col("key"), self.buckets).alias("bucket"))
        # large buckets are several files, so that a hot one is several tasks
        out = out.repartition("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4))).sortWithinPartitions("bucket", "key")
        out.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"file://{self.folder}/{name}/blobs")

    def add(self, rows: DataFrame) -> None:
        """rows(key, ..[, blob]): a new run. Of rows of one key the greatest in (mtime, blob) stays, whatever their order."""
        name = uuid.uuid4().hex
        blobs = "blob" in rows.columns
        if blobs:
            order = [c for c in ("mtime", "blob") if c in rows.columns]
            rows = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), F.struct(*order)).alias("r")).select("key", "r.*")
            rows = shared.staged(rows, "run")  # read twice, without blobs the second time
            self._write_blobs(rows.where("blob IS NOT NULL"), name)
            rows = rows.withColumn("blob_run", F.when(F.col("blob").isNotNull(), F.lit(name))).drop("blob")
        elif "mtime" in rows.columns and "blob_run" not in rows.columns:
            rows = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "mtime").alias("r")).select("key", "r.*")
        self._write_index(rows, name)
        self._commit(lambda runs: [*runs, {"name": name, "level": 0}])

    def merge(self, spark: SparkSession) -> int:
        """Join neighbouring runs of one level while ``fan`` of them stand together; the number of merges."""
        merges = 0
        while picked := self._neighbours(self.runs()):
            oldest = self.runs()[: len(picked)] == picked
            merges += self._join(spark, picked, picked[0]["level"] + 1, keep_deleted=not oldest)
        return merges

    def _neighbours(self, runs: list[dict]) -> list[dict] | None:
        for i in range(len(runs) - self.fan + 1):
            if len({r["level"] for r in runs[i : i + self.fan]}) == 1:
                return runs[i : i + self.fan]
        return None

    def _join(self, spark: SparkSession, picked: list[dict], level: int, keep_deleted: bool, blobs: bool = False) -> int:
        name = uuid.uuid4().hex
        columns = [x.split(" ")[0] for x in INDEX.split(", ")][1:]
        rows = self.latest(spark, *[c for c in columns if c != "deleted"], "deleted", runs=picked, gone=keep_deleted)
        if blobs:
            self._write_blobs(self.blobs(rows.select("key", "blob_run")), name)
            rows = rows.withColumn("blob_run", F.when(F.col("blob_run").isNotNull(), F.lit(name)))
        self._write_index(rows, name)
        done = []

        def change(runs: list[dict]) -> list[dict] | None:
            names = [r["name"] for r in picked]
            at = next((i for i in range(len(runs)) if [r["name"] for r in runs[i : i + len(names)]] == names), None)
            if at is None:
                return None  # merged by another meanwhile
            done.append(1)
            return [*runs[:at], {"name": name, "level": level}, *runs[at + len(names) :]]

        self._commit(change)
        return min(len(done), 1)

    def compact(self, spark: SparkSession) -> None:
        """All runs as one, without deleted keys and without blobs that no key names."""
        runs = self.runs()
        if runs:
            self._join(spark, runs, max(r["level"] for r in runs) + 1, keep_deleted=False, blobs=True)

    def vacuum(self, spark: SparkSession) -> None:
        """Remove older manifests, and folders that the newest does not need. Only when no reader of an older one is left."""
        number, text = self._manifest()
        runs = json.loads(text or '{"runs": []}')["runs"]
        named = {r["name"] for r in runs} | {r.blob_run for r in self.index(spark, runs).select("blob_run").distinct().collect()}  # at most one a run ever made
        for n in os.listdir(f"{self.folder}/manifest"):
            if n.isdigit() and int(n) < number:
                os.remove(f"{self.folder}/manifest/{n}")
        for n in os.listdir(self.folder):
            if n != "manifest" and n not in named:
                shutil.rmtree(f"{self.folder}/{n}")
