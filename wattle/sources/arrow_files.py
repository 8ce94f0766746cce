"""Feather / Arrow IPC files as a Spark source and sink.

One input partition per record batch; only the wanted columns of a batch are read
(``columns``), and batches are cut by simple comparisons that Spark hands down, which
Spark checks again.  Dictionary columns come as their values.  Timestamps finer than a
microsecond are an error, not cut.  The schema is that of the first file by name; a file
that lacks a column or has values that do not fit its type is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from wattle.session import ship_package
from wattle.sources.files import StagedParts, WrittenPart, data_files, filesystem

FORMAT = "arrow_file"
BATCH_BYTES = 32 * 1024 * 1024
SUFFIXES = (".arrow", ".feather", ".ftr")
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
#: what a comparison is handed down for: its value is the same in Spark and in Arrow
SIMPLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType)


def plain_schema(schema: pa.Schema) -> pa.Schema:
    """Without dictionaries, timestamps in microseconds."""
    def plain(t: pa.DataType) -> pa.DataType:
        if pa.types.is_dictionary(t):
            return plain(t.value_type)
        return pa.timestamp("us", t.tz) if pa.types.is_timestamp(t) else t
    return pa.schema([pa.field(f.name, plain(f.type)) for f in schema])


def large_batches(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``size`` bytes: a batch is a task of the scan."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class Batch(InputPartition):
    file: str
    number: int


class ArrowReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.columns, self.path = schema, path
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        simple = {f.name for f in self.columns if isinstance(f.dataType, SIMPLE)}
        self.tests = [f for f in filters if len(f.attribute) == 1 and (isinstance(f, IsNotNull) or (type(f) in COMPARE and f.attribute[0] in simple))]
        return filters

    def partitions(self) -> list[InputPartition]:
        out = []
        for file in data_files(self.path, SUFFIXES):
            with filesystem(self.path)[0].open_input_file(file) as f:
                out += [Batch(file, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if partition is None:                                # no file holds a batch
            return
        names = self.columns.names
        with filesystem(self.path)[0].open_input_file(partition.file) as f:
            have = pa.ipc.open_file(f).schema
            wanted = pa.ipc.IpcReadOptions(included_fields=sorted(have.get_field_index(n) for n in names))
            batch = pa.ipc.open_file(f, options=wanted).get_batch(partition.number)
            for t in self.tests:
                column = batch.column(t.attribute[0])
                batch = batch.filter(pc.is_valid(column) if isinstance(t, IsNotNull) else COMPARE[type(t)](column, t.value))
            table = pa.Table.from_batches([batch]).select(names).cast(to_arrow_schema(self.columns))
            yield from table.to_batches()


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.parts = StagedParts(path, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]):
        files, file, number = self.parts.new_file()
        rows, out = 0, None
        with files.open_output_stream(file) as sink:
            for batch in large_batches(iterator):
                out = out or pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        return WrittenPart(number, file, rows)

    def commit(self, messages: list) -> None:
        self.parts.publish(messages, "part-{:08d}.arrow")

    def abort(self, messages: list) -> None:
        self.parts.discard()


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        path = self.options["path"]
        files = data_files(path, SUFFIXES)
        if not files:
            raise FileNotFoundError(f"no {', '.join(SUFFIXES)} file in {path}")
        with filesystem(path)[0].open_input_file(files[0]) as f:
            schema = plain_schema(pa.ipc.open_file(f).schema)
        wanted = json.loads(self.options.get("columns", "null"))
        return from_arrow_schema(pa.schema([schema.field(c) for c in wanted]) if wanted else schema, prefer_timestamp_ntz=True)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowReader(schema, self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowWriter(self.options["path"], overwrite)


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The Feather / Arrow files under ``path`` (a file or a folder), ``columns`` only if given."""
    _register(spark)
    reader = spark.read.format(FORMAT)
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load(path)


def write_arrow(df: DataFrame, path: str) -> str:
    """``df`` as Arrow files, one per partition that has rows; what ``path`` held is replaced at commit."""
    _register(df.sparkSession)
    df.write.format(FORMAT).mode("overwrite").save(path)
    return path
