"""Partitioned scan of table files: a Python data source, registered as strataline_dbf.

Records have a fixed length, so a partition is a range of ordinals and seeks to its first byte; memo values are read by
pointer in the same task. Options: path; memo (its path); encoding (auto); errors (strict, ignore, replace); columns
(comma-joined, the others read as null and their memo blocks aren't touched); missingMemo (fail, null-with-warning);
recordsPerPartition.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from strataline.sources import files
from strataline.sources import table_format as tf

RECORDS = 200_000
#: Records and bytes of an Arrow batch.
BATCH, BATCH_BYTES = 8192, 1 << 24
WIDE = Context(prec=80)
EXTRA = (
    T.StructField("_ordinal", T.LongType()),
    T.StructField("_deleted", T.BooleanType()),
    T.StructField("_raw_record", T.BinaryType()),
    T.StructField("_raw_text_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_binary_memo_fields", T.ArrayType(T.StringType())),
)


def column_type(layout: tf.Layout, f: tf.Field) -> T.DataType:
    kind = f.dbf_type
    if kind in "CVM":
        return T.StringType()
    if layout.is_double(f):
        return T.DoubleType()
    if kind in "NF":
        return T.DecimalType(38, min(f.decimals, 18))
    simple = {"I": T.IntegerType(), "+": T.IntegerType(), "Y": T.DecimalType(19, 4), "L": T.BooleanType(), "D": T.DateType(), "T": T.TimestampNTZType(), "@": T.TimestampNTZType()}
    return simple.get(kind, T.BinaryType())


def table_schema(layout: tf.Layout) -> T.StructType:
    """Columns of a table, their descriptors as metadata, and the reserved columns."""
    own = [
        T.StructField(f.name, column_type(layout, f), True, {"dbf_type": f.dbf_type, "length": f.length, "decimal_count": f.decimals, "flags": f.flags, "ordinal": f.ordinal})
        for f in layout.fields
    ]
    return T.StructType([*own, *EXTRA])


def layout_of(path: str, encoding: str = "auto", errors: str = "strict") -> tf.Layout:
    head = files.read_bytes(path, tf.HEADER)
    if len(head) < tf.HEADER:
        raise tf.FormatError("the header is cut short")
    return tf.parse_layout(files.read_bytes(path, int.from_bytes(head[8:10], "little")), encoding, errors)


def marked_end(f, layout: tf.Layout, first: int, last: int) -> int | None:
    """Ordinal of the first end mark among records [first, last) of an open table file, from the markers alone."""
    step = max(1, (1 << 24) // layout.record_length)
    for at in range(first, last, step):
        f.seek(layout.header_length + at * layout.record_length)
        markers = f.read(min(step, last - at) * layout.record_length)[:: layout.record_length]
        if (end := markers.find(b"\x1a")) >= 0:
            return at + end
    return None


def ranges(path: str, layout: tf.Layout, size: int) -> list[tuple[int, int]]:
    """Ranges of at most size records up to the file's end; the header's count isn't relied on."""
    count = -(-max(0, files.size(path) - layout.header_length) // layout.record_length)
    return [(a, min(a + size, count)) for a in range(0, count, size)] or [(0, 0)]


def end_of(spark: SparkSession, path: str, layout: tf.Layout, size: int) -> int | None:
    """The first end mark of a table of several ranges, each looked through by a task; it ends the table for all of them."""
    found = ranges(path, layout, size)
    if len(found) < 2:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, p = files.at(path)
        for batch in batches:
            with filesystem.open_input_file(p) as f:
                ends = [marked_end(f, layout, a, b) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64())], names=["end"])

    rows = spark.createDataFrame(found, "a long, b long").repartition(min(len(found), 4096))
    return rows.mapInArrow(run, "end long").agg(F.min("end")).first()[0]


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class TableReader(DataSourceReader):
    """Ranges of records, read as Arrow batches."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.read_schema = options, schema

    def partitions(self) -> list[Range]:
        o = self.options
        layout = layout_of(o["path"], o.get("encoding", "auto"), o.get("errors", "strict"))
        found = ranges(o["path"], layout, int(o.get("recordsperpartition", o.get("recordsPerPartition", RECORDS))))
        end = o.get("end")
        if end is None and len(found) > 1:  # not through read_table, whose tasks look for the mark
            filesystem, p = files.at(o["path"])
            with filesystem.open_input_file(p) as f:
                end = marked_end(f, layout, 0, found[-1][1])
        return [Range(a, b if end is None else min(b, int(end))) for a, b in found if end is None or a < int(end)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        o = self.options
        errors, missing = o.get("errors", "strict"), o.get("missingmemo", o.get("missingMemo", "fail"))
        layout = layout_of(o["path"], o.get("encoding", "auto"), errors)
        tf.check_supported(layout)
        wanted = set(o["columns"].split(",")) if o.get("columns") else None
        schema = to_arrow_schema(self.read_schema)
        filesystem, p = files.at(o["path"])
        memo_file = None
        if o.get("memo"):
            memo_system, memo_path = files.at(o["memo"])
            memo_file = memo_system.open_input_file(memo_path)
        memo = tf.Memo(memo_file) if memo_file else None

        def column(values: tuple, kind: pa.DataType) -> pa.Array:
            if pa.types.is_decimal(kind):
                unit = Decimal(1).scaleb(-kind.scale)
                values = [None if v is None else v.quantize(unit, ROUND_HALF_UP, WIDE) for v in values]
            return pa.array(values, kind)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows, held = [], 0
        with filesystem.open_input_file(p) as f:
            f.seek(layout.header_length + part.first * layout.record_length)
            for ordinal in range(part.first, part.last):
                raw = f.read(layout.record_length)
                if not raw or raw[:1] == b"\x1a":
                    break
                if len(raw) < layout.record_length or raw[:1] not in (b" ", b"*"):
                    raise tf.FormatError(f"record {ordinal + 1}: " + ("cut short" if len(raw) < layout.record_length else f"marker {raw[:1]!r}"))
                try:
                    values, raw_texts, binary = tf.read_record(layout, raw, memo, errors, wanted, missing)
                except tf.FormatError as e:
                    raise tf.FormatError(f"record {ordinal + 1}: {e}") from e
                rows.append((*values, ordinal, raw[:1] == b"*", raw, list(raw_texts.items()), binary))
                held += len(raw) + sum(len(v) for v in values if isinstance(v, (str, bytes)))
                if len(rows) == BATCH or held > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)
        if memo_file:
            memo_file.close()


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strataline_dbf"

    def schema(self) -> T.StructType:
        layout = layout_of(self.options["path"], self.options.get("encoding", "auto"), self.options.get("errors", "strict"))
        tf.check_supported(layout)
        return table_schema(layout)

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(dict(self.options), schema)


def read_table(spark: SparkSession, path: str, memo: str | None = None, **options) -> DataFrame:
    """DataFrame of a table file; _ordinal is the disk order."""
    spark.dataSource.register(TableSource)
    reader = spark.read.format("strataline_dbf").option("path", str(path))
    layout = layout_of(path, options.get("encoding") or "auto", options.get("errors") or "strict")
    end = end_of(spark, str(path), layout, int(options.get("recordsPerPartition") or RECORDS))
    for k, v in ({"memo": memo, "end": end} | options).items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load()


