"""A data source of Arrow stream files: written a file a task, committed by one index, read by shard, batch and row number.

    shards.register(spark)
    df.write.format("arrow_shards").mode("overwrite").option("key", "doc_id").save(path)
    spark.read.format("arrow_shards").load(path).where("doc_id = 7")

A file holds batches of at most `batch` rows; its columns named in `half` are stored as 16-bit floats. `_index.json` names
the files in the order of the tasks that wrote them, and of each batch the place in its file, the rows and the range of
the key. It is written last and takes effect by one rename, so readers see a whole write or none, and a write that is
aborted leaves no file. Filters on the key are pushed: files and batches out of their range are not read. Paths are those
of pyarrow's file systems, which driver and executors must share.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

INDEX, ROWS = "_index.json", 1_000_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    plain = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(plain if "://" in plain else f"file://{plain}")


def _half(schema: pa.Schema, names: list[str]) -> pa.Schema:
    """The schema with lists of 16-bit floats in the named columns."""
    return pa.schema([pa.field(f.name, pa.list_(pa.float16())) if f.name in names else f for f in schema])


def index(path: str) -> dict:
    """The index of a committed write: schema (bytes in hex), key, and files with their batches."""
    store, at = _store(path)
    with store.open_input_stream(posixpath.join(at, INDEX)) as f:
        return json.loads(f.read())


@dataclass
class _Written(WriterCommitMessage):
    task: int
    name: str
    batches: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.key = options["path"], options.get("key")
        self.rows, self.half = int(options.get("batch", ROWS)), [c for c in options.get("half", "").split(",") if c]
        self.schema, self.overwrite, self.job = to_arrow_schema(schema), overwrite, uuid.uuid4().hex
        if self.key and self.key not in self.schema.names:
            raise ValueError(f"no column {self.key}")

    def _name(self, attempt: int) -> str:
        return f"{self.job}-{attempt}.arrow"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        name, batches = self._name(task.taskAttemptId()), []
        target = posixpath.join(at, name)
        held, n = [], 0

        def flush(w: pa.ipc.RecordBatchFileWriter, stream) -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            batch = whole.to_batches(max_chunksize=self.rows)[0]
            batch = pa.record_batch([c.cast(f.type) for c, f in zip(batch.columns, w_schema, strict=True)], schema=w_schema)
            place = stream.tell()
            w.write_batch(batch)
            key = pc.min_max(batch.column(batch.schema.get_field_index(self.key))) if self.key else None
            batches.append({"at": place, "rows": batch.num_rows, "min": key["min"].as_py() if key else None, "max": key["max"].as_py() if key else None})

        w_schema = _half(self.schema, self.half)
        try:
            with store.open_output_stream(target) as stream, pa.ipc.new_stream(stream, w_schema) as w:
                for batch in iterator:
                    for start in range(0, batch.num_rows, self.rows):
                        part = batch.slice(start, self.rows)
                        while part.num_rows:
                            take = min(part.num_rows, self.rows - n)
                            held.append(part.slice(0, take))
                            n, part = n + take, part.slice(take)
                            if n == self.rows:
                                flush(w, stream)
                                held, n = [], 0
                if n:
                    flush(w, stream)
        except BaseException:
            store.delete_file(target)
            raise
        if not batches:  # an empty task leaves no file
            store.delete_file(target)
        return _Written(task.partitionId(), name, batches)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = _store(self.path)
        old = {}
        if store.get_file_info(posixpath.join(at, INDEX)).type == fs.FileType.File:
            old = index(self.path)
        new = [{"name": m.name, "batches": m.batches} for m in sorted((m for m in messages if m), key=lambda m: m.task) if m.batches]
        files = new if self.overwrite else old.get("files", []) + new
        if not self.overwrite and old and (old["key"] != self.key or old["schema"] != self._bytes()):
            raise ValueError("rows to append have another schema or key")
        store.create_dir(at, recursive=True)
        fresh = posixpath.join(at, f"_{self.job}.json")
        with store.open_output_stream(fresh) as f:
            f.write(json.dumps({"schema": self._bytes(), "key": self.key, "files": files}).encode())
        store.move(fresh, posixpath.join(at, INDEX))
        kept = {f["name"] for f in files}
        for f in old.get("files", []):
            if f["name"] not in kept:
                store.delete_file(posixpath.join(at, f["name"]))
        self._sweep(kept)

    def _bytes(self) -> str:
        return self.schema.serialize().to_pybytes().hex()

    def _sweep(self, kept: set[str]) -> None:
        """Delete what attempts of this job have left that are not in the index."""
        store, at = _store(self.path)
        for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.base_name.startswith((self.job, f"_{self.job}")) and info.base_name not in kept:
                store.delete_file(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._sweep(set())


@dataclass
class _Part(InputPartition):
    name: str
    batches: list[tuple[int, int]]


def _within(bounds: dict, filters: list[tuple[str, object]]) -> bool:
    low, high = bounds["min"], bounds["max"]
    if low is None:
        return False  # a batch of null keys, which no comparison holds for
    tests = {"=": lambda v: low <= v <= high, "in": lambda v: any(low <= x <= high for x in v if x is not None), ">": lambda v: high > v, ">=": lambda v: high >= v, "<": lambda v: low < v, "<=": lambda v: low <= v}
    return all(tests[op](v) for op, v in filters)


_KINDS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def batches_at(path: str, name: str, places: list[int]) -> Iterator[pa.RecordBatch]:
    """The batches of a file that begin at the given places."""
    store, at = _store(path)
    with store.open_input_file(posixpath.join(at, name)) as f:
        schema = pa.ipc.read_schema(pa.ipc.read_message(f))
        for place in places:
            f.seek(place)
            message = pa.ipc.read_message(f)
            if message.type == "schema":  # which a stream writes with its first batch
                message = pa.ipc.read_message(f)
            yield pa.ipc.read_record_batch(message, schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, to_arrow_schema(schema), []
        self.held = index(path)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _KINDS and f.attribute == (self.held["key"],) and f.value is not None:
                self.filters.append((_KINDS[type(f)], f.value))
            yield f  # Spark still tests each row

    def partitions(self) -> list[InputPartition]:
        parts = []
        for f in self.held["files"]:
            kept = [(b["at"], b["rows"]) for b in f["batches"] if not self.filters or _within(b, self.filters)]
            if kept:
                parts.append(_Part(f["name"], kept))
        return parts or [_Part("", [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for batch in batches_at(self.path, partition.name, [at for at, _ in partition.batches]) if partition.name else ():
            yield pa.record_batch([batch.column(f.name).cast(f.type) for f in self.schema], schema=self.schema)


class ArrowShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def schema(self) -> StructType:
        return from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(index(self.options["path"])["schema"]))))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _fetched(path: str, schema: pa.Schema, columns: list[str], key: str | None):
    """Requests (place, file, at, row or wanted) of one batch as the batch's rows: by row number, or by key where one is named."""

    def run(asked: pa.Table) -> pa.Table:
        batch = next(batches_at(path, asked.column("file")[0].as_py(), [asked.column("at")[0].as_py()]))
        if key:
            place = pc.index_in(asked.column("wanted").combine_chunks(), batch.column(key))  # the first row with the key
            asked, place = asked.filter(pc.is_valid(place)), place.drop_null()
        else:
            place = asked.column("row").combine_chunks()
        rows = [batch.column(c).cast(schema.field(c).type).take(place) for c in columns]
        return pa.Table.from_arrays([asked.column("place").combine_chunks(), *rows], names=["place", *columns])

    return run


def _batch_table(spark: SparkSession, held: dict) -> DataFrame:
    """(file, at, first, rows, low, high): a row for each batch, with the number of its first row in the whole table."""
    rows, first = [], 0
    for f in held["files"]:
        for b in f["batches"]:
            rows.append((f["name"], b["at"], first, b["rows"], b["min"], b["max"]))
            first += b["rows"]
    return spark.createDataFrame(rows, "file string, at long, first long, rows long, low long, high long")


def _meet(asked: DataFrame, batches: DataFrame, value: str, low: str, past: str) -> DataFrame:
    """asked with each row's batch: both in one order of numbers, in which the last batch to begin before a row is its own."""
    width = max(1, int(batches.agg(F.max(F.col(past) - F.col(low))).first()[0] or 1))
    # a batch covers few cells of its own width, so the join is by equality
    cells = batches.withColumn("_cell", F.explode(F.sequence(F.expr(f"{low} div {width}"), F.expr(f"({past} - 1) div {width}"))))
    return asked.withColumn("_cell", F.expr(f"{value} div {width}")).join(cells, "_cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(past))).drop("_cell")


def take(spark: SparkSession, path: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(place, columns): the rows with the given numbers, from 0 in the order they were written in; rows (place, number).

    Only the batches that hold one are read, each once, and of a file only these. A number may be asked for at several
    places; numbers out of range and null ones give no row. Order by place for the caller's order.
    """
    held = index(path)
    schema = pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(held["schema"])))
    batches = _batch_table(spark, held).withColumn("past", F.col("first") + F.col("rows"))
    met = _meet(rows.select("place", F.col("number").cast("long").alias("number")), batches, "number", "first", "past")
    asked = met.select(F.col("place").cast("long").alias("place"), "file", "at", (F.col("number") - F.col("first")).alias("row"))
    out = StructType.fromDDL("place long").fields + [f for c in columns for f in from_arrow_schema(pa.schema([schema.field(c)])).fields]
    return asked.groupBy("file", "at").applyInArrow(_fetched(path, schema, columns, None), StructType(out))


def gather(spark: SparkSession, path: str, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """ids (key) with the columns of the row of that key, and ok, whether there is one; of several rows the first written in its batch.

    Keys are whole numbers that rise with the batches, as they do after a write sorted by them; ranges that overlap cost
    reading, not answers, as long as a key stands in one batch. A batch is read if a key lies within its range.
    """
    held = index(path)
    schema = pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(held["schema"])))
    batches = _batch_table(spark, held).where("low IS NOT NULL").withColumn("past", F.col("high") + 1)
    wanted = ids.select(F.col(key).cast("long").alias("wanted")).where("wanted IS NOT NULL").distinct()
    asked = _meet(wanted, batches, "wanted", "low", "past").select(F.col("wanted").alias("place"), "file", "at", "wanted")
    out = StructType.fromDDL("place long").fields + [f for c in columns for f in from_arrow_schema(pa.schema([schema.field(c)])).fields]
    found = asked.groupBy("file", "at").applyInArrow(_fetched(path, schema, columns, key), StructType(out)).dropDuplicates(["place"])
    joined = ids.join(found.withColumnRenamed("place", "_place"), F.col(key).cast("long") == F.col("_place"), "left")
    return joined.withColumn("ok", F.col("_place").isNotNull()).drop("_place")
