"""Directories of Arrow streams, one for each split, as `datasets` saves them: dataset_dict.json names the splits, state.json of
a split its files.

Reading: a partition is a run of record batches of one file. Where a file can be mapped (a local or mounted path) the driver
looks at the heads of its messages only, and a run has about RUN_BYTES; elsewhere, and in streams with dictionaries, a file is
one run. Only the columns of the schema that is asked for are made. Writing: each task writes files of its own, and the lists
of files are written once all of them are there, so a directory that can be read is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of record batches in one partition.
RUN_BYTES = 64 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inner.rstrip("/")


def _json(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_file(path) as f:
        return json.loads(f.read())


def split_names(path: str) -> list[str]:
    """The splits of a directory, in their order."""
    system, inner = _place(path)
    return _json(system, f"{inner}/dataset_dict.json")["splits"]


@dataclass
class Run(InputPartition):
    """Record batches of one file: the place of the first, and how many (all, if None)."""

    path: str
    at: int
    count: int | None


def _files(path: str) -> list[str]:
    system, inner = _place(path)
    return [f"{inner}/{x['filename']}" for x in _json(system, f"{inner}/state.json")["_data_files"]]


def _runs(path: str, most: int) -> list[Run]:
    """Runs of a file that can be mapped: a message's body is skipped, not read."""
    runs, size, count, start = [], 0, 0, 0
    with pa.memory_map(path) as f:
        ipc.read_schema(f)
        start = f.tell()
        while True:
            before = f.tell()
            try:
                message = ipc.read_message(f)
            except EOFError:
                break
            if message.type != "record batch":
                return [Run(path, 0, None)]
            size, count = size + f.tell() - before, count + 1
            if size >= most:
                runs.append(Run(path, start, count))
                size, count, start = 0, 0, f.tell()
    return runs + ([Run(path, start, count)] if count else [])


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, most: int):
        self.path, self.schema, self.most = path, schema, most

    def partitions(self) -> list[Run]:
        local = isinstance(_place(self.path)[0], fs.LocalFileSystem)
        found = [r for f in _files(self.path) for r in (_runs(f, self.most) if local else [Run(f, 0, None)])]
        return found or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        if partition.count == 0:
            return
        system, _ = _place(self.path)
        with pa.memory_map(partition.path) if isinstance(system, fs.LocalFileSystem) else system.open_input_stream(partition.path) as f:
            if partition.count is None:
                found = ipc.open_stream(f)
            else:
                held = ipc.read_schema(f)
                f.seek(partition.at)
                found = (ipc.read_record_batch(ipc.read_message(f), held) for _ in range(partition.count))
            for batch in found:
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(wanted.field(c).type) for c in wanted.names], schema=wanted)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, inner = _place(self.path)
        system.create_dir(inner)
        name, rows, schema = f"data-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow", 0, to_arrow_schema(self.schema)
        with system.open_output_stream(f"{inner}/{name}") as out, ipc.new_stream(out, schema) as stream:
            for batch in iterator:
                stream.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, schema.types, strict=True)], schema=schema))
                rows += batch.num_rows
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = _place(self.path)
        names = sorted(m.name for m in messages if m and m.rows)
        system.create_dir(inner)
        with system.open_output_stream(f"{inner}/state.json") as out:
            out.write(json.dumps({"_data_files": [{"filename": n} for n in names]}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, inner = _place(self.path)
        for m in filter(None, messages):
            system.delete_file(f"{inner}/{m.name}")


class ArrowSplit(DataSource):
    """The format arrow_split: one split's directory. Options: path, run_bytes."""

    @classmethod
    def name(cls) -> str:
        return "arrow_split"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        system, _ = _place(self.options["path"])
        with system.open_input_stream(files[0]) as f:
            return from_arrow_schema(ipc.open_stream(f).schema)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema, int(self.options.get("run_bytes", RUN_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema)


def read_saved(spark: SparkSession, path: str, schema: str | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """All splits of a saved directory, one below the other, with their names as `split`. schema: the columns that are wanted."""
    spark.dataSource.register(ArrowSplit)
    out = None
    for name in split_names(path):
        reader = spark.read.format("arrow_split").option("run_bytes", run_bytes)
        rows = (reader.schema(schema) if schema else reader).load(f"{path}/{name}")
        rows = rows.selectExpr("*", f"'{name}' as split")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def save(splits: dict[str, DataFrame], path: str) -> None:
    """Writes a directory of splits. It can be read once dataset_dict.json is there, which is written last."""
    system, inner = _place(path)
    for name, rows in splits.items():
        rows.sparkSession.dataSource.register(ArrowSplit)
        rows.write.format("arrow_split").mode("append").save(f"{path}/{name}")
    with system.open_output_stream(f"{inner}/dataset_dict.json") as out:
        out.write(json.dumps({"splits": list(splits)}).encode())
