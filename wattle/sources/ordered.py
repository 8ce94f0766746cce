"""Sorted CSV in parts with one header: the files in the order of their names, put one
after another, are the sorted file.

Rows are dealt to ranges of the key and sorted there; each task writes one part, and the
driver names the parts by range when the job commits.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from wattle.session import ship_package
from wattle.sources.files import StagedParts, WrittenPart

FORMAT = "ordered_csv"
HEADER, ROWS = "part-00000000-header.csv", "part-{:08d}-rows.csv"
PLAIN = (T.NumericType, T.StringType, T.BooleanType)


class OrderedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, names: list[str]):
        self.parts, self.names = StagedParts(path, overwrite), names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenPart:
        files, file, number = self.parts.new_file()
        rows = 0
        with files.open_output_stream(file) as sink:
            for batch in iterator:
                pacsv.write_csv(batch, sink, pacsv.WriteOptions(include_header=False, quoting_style="needed"))
                rows += batch.num_rows
        return WrittenPart(number, file, rows)

    def commit(self, messages: list) -> None:
        line = io.StringIO()
        csv.writer(line, lineterminator="\n").writerow(self.names)
        self.parts.publish(messages, ROWS, {HEADER: line.getvalue().encode()})

    def abort(self, messages: list) -> None:
        self.parts.discard()


class OrderedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return OrderedWriter(self.options["path"], overwrite, schema.names)


def write_ordered(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> str:
    """``df`` sorted by ``order`` as CSV parts (see the module); numbers, texts and booleans
    only, null as nothing.  What ``path`` held is replaced at commit.  ``partitions``: number of ranges, by default
    that of the session's shuffles."""
    other = [f.name for f in df.schema if not isinstance(f.dataType, PLAIN)]
    if other:
        raise ValueError(f"format these columns as text first: {other}")
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(OrderedCsv)
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.format(FORMAT).mode("overwrite").save(path)
    return path


def read_ordered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a file set written by :func:`write_ordered`."""
    return spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(f"{path.rstrip('/')}/*-rows.csv")
