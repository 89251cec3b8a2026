"""Feather files, read batch by batch: the footer of each file tells its record batches, and tasks share these.

Where tasks can open a path themselves (local and common remote file systems), only the footer and the wanted columns of a batch are read, so files of
any size are read by many tasks. On other file systems Spark reads a file as one value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tablesight.sources.splits import decoded_path


def open_file(path: str):
    """A file as a seekable handle, by the scheme of its path."""
    system, name = _system(path)
    return system.open_input_file(name)


def _system(path: str) -> tuple[pa.fs.FileSystem, str]:
    # Spark writes local paths with one slash, which is no URI of an empty host to others.
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def can_open(path: str) -> bool:
    """Whether tasks can open such a path without Spark."""
    try:
        _system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def files_under(spark: SparkSession, path, pattern: str) -> DataFrame:
    """Rows ``(path, length)``; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(decoded_path(F.col("path")).alias("path"), "length")


def put_file(folder: str, name: str, content: bytes) -> pa.RecordBatch:
    """Write a small file from a task, whole or not at all, and return its path as a row."""
    system, at = _system(folder)
    system.create_dir(at, recursive=True)
    hidden = f"{at}/_{name}-{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(hidden) as stream:
        stream.write(content)
    system.move(hidden, f"{at}/{name}")
    return pa.RecordBatch.from_pydict({"file": [f"{at}/{name}"]})


def write_feather(df: DataFrame, path: str, compression: str | None = "lz4") -> None:
    """One file per task that has rows. A task that runs again replaces its own file."""
    schema = to_arrow_schema(df.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _system(path)
        part = TaskContext.get().partitionId()
        writer, target = None, f"{folder}/part-{part:05d}.feather"
        hidden = f"{folder}/_part-{part:05d}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if writer is None:
                system.create_dir(folder, recursive=True)
                stream = system.open_output_stream(hidden)
                writer = pa.ipc.new_file(stream, schema, options=pa.ipc.IpcWriteOptions(compression=compression))
            if batch.num_rows:
                writer.write_table(pa.Table.from_batches([batch]).cast(schema))
        if writer is not None:
            writer.close()
            stream.close()
            system.move(hidden, target)
            yield pa.RecordBatch.from_pydict({"file": [target]})

    df.mapInArrow(write, "file string").count()


def read_feather(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """All Feather (version 2) files under a path; the first file's columns are the table's, or those of them in ``columns``."""
    files = files_under(spark, path, "*.feather")
    first = files.orderBy("path").select("path").first()
    if first is None:
        raise ValueError(f"no feather file under {path}")
    opened = can_open(first["path"])
    if not opened:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select("path", "content")

    def reader(source, wanted: Sequence[str] | None = None) -> pa.ipc.RecordBatchFileReader:
        handle = open_file(source.as_py()) if opened else pa.py_buffer(source.as_buffer())
        if wanted is None:
            return pa.ipc.open_file(handle)
        named = pa.ipc.open_file(handle).schema.names
        return pa.ipc.open_file(handle, options=pa.ipc.IpcReadOptions(included_fields=[named.index(w) for w in wanted]))

    def schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(batch.num_columns - 1 if not opened else 0):
                yield pa.RecordBatch.from_pydict({"schema": [reader(source).schema.serialize().to_pybytes()]})

    described = files.orderBy("path").limit(1).mapInArrow(schema_of, "schema binary").first()
    arrow = pa.ipc.read_schema(pa.py_buffer(bytes(described["schema"])))
    arrow = arrow if columns is None else pa.schema([arrow.field(c) for c in columns])
    plain = pa.schema([
        pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in arrow])
    schema = from_arrow_schema(plain)
    target = to_arrow_schema(schema)

    def converted(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        return pa.Table.from_batches([batch]).select(target.names).cast(plain).cast(target).to_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("content"):
                held = reader(source, target.names)
                for i in range(held.num_record_batches):
                    yield from converted(held.get_batch(i))

    if not opened:
        return files.mapInArrow(whole, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path"):
                n = reader(source).num_record_batches
                yield pa.RecordBatch.from_pydict({"path": [source.as_py()] * n, "batch": pa.array(range(n), pa.int32())})

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for source, number in zip(batch.column("path"), batch.column("batch").to_pylist()):
                if source.as_py() != at:
                    at, held = source.as_py(), reader(source, target.names)
                yield from converted(held.get_batch(number))

    bytes_at_once = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB"))
    tasks = files.agg(F.ceil(F.sum("length") / bytes_at_once)).first()[0] or 1
    spread = files.mapInArrow(listed, "path string, batch int").repartitionByRange(max(int(tasks), spark.sparkContext.defaultParallelism), "path", "batch").sortWithinPartitions("path", "batch")
    return spread.mapInArrow(some, schema)
