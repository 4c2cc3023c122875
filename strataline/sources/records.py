"""Record scans of exported files: (_ordinal, record) with a record as JSON text, and JSONL conversions.

A file's lines are read in splits by many tasks; a line's order is its split's first byte and its place in the split.
Errors name lines, never contents.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.operators import overflow, policies, profile
from strataline.sources import files, xlsx

#: Bytes of the ranges that fixed_lines reads, and seconds between two looks at a running conversion.
SPLIT, POLL = 32 << 20, 0.1
INPUT_FORMATS = ("jsonl", "json", "csv", "xlsx")
#: Field types whose CSV cells are text.
TEXT_TYPES = ("C", "V", "D", "T", "@", "M", "G", "P", "Q", "W")
#: Names of declared column types.
KINDS = {"boolean": "boolean", "bool": "boolean", "float": "double", "number": "double", "integer": "bigint", "int": "bigint", "null": "string", "str": "string", "string": "string", "text": "string"}


class ConversionError(ValueError):
    """A conversion that can't go on."""


class ConversionCancelled(ConversionError):
    """A conversion that its caller stopped."""


@dataclass
class ConversionStats:
    source: str
    destination: str
    records: int
    skipped_invalid: int = 0
    input_bytes: int = 0
    output_bytes: int = 0
    seconds: float = 0.0
    sheets: int = 0
    overflow_values: int = 0
    overflow_parts: int = 0
    overflow_sheets: int = 0
    columns: list[str] = field(default_factory=list)

    @property
    def megabytes_per_second(self) -> float:
        return self.input_bytes / 1e6 / self.seconds if self.seconds else 0.0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, place, line) of a text file's non-blank lines, the byte-order mark removed.

    Blocks are the splits of this very read: they order lines within one pass, and mean nothing to another.
    """
    text = spark.read.text(str(path)).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return _trimmed(text)


def _trimmed(text: DataFrame) -> DataFrame:
    bare = F.when((F.col("block") == 0) & F.col("line").startswith("\ufeff"), F.substring("line", 2, 2**31 - 1)).otherwise(F.col("line"))
    return text.withColumn("line", F.regexp_replace(bare, "\r$", "")).where(F.length(F.trim("line")) > 0)


def fixed_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines over ranges of SPLIT bytes that are set here: every read, on any cluster, numbers them alike."""
    path = str(path)
    filesystem, p = files.at(path)
    size = filesystem.get_file_info(p).size or 0
    count = max(1, -(-size // SPLIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, p = files.at(path)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                with filesystem.open_input_file(p) as f:
                    yield from _range_lines(f, number * SPLIT, (number + 1) * SPLIT)

    ranges = spark.range(0, count, 1, min(count, 4096))
    return _trimmed(ranges.mapInArrow(run, "block long, place long, line string"))


def _range_lines(f, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Lines that begin in [start, end) of a binary file, the last one read to its end."""
    at, place, size, held = start, 0, 1 << 22, b""
    if start:
        # A line begins here only if a line end is just before.
        f.seek(start - 1)
        at -= 1
        while True:
            data = f.read(size)
            cut = data.find(b"\n")
            if cut >= 0 or not data:
                at, held = at + cut + 1, data[cut + 1 :]
                break
            at += len(data)
            if at >= end:
                return
        if not data:
            return
    while at < end:
        cut = held.rfind(b"\n")
        if cut < 0:
            data = f.read(size)
            if not data:
                if held:
                    yield _line_batch(start, place, [held])
                return
            held, size = held + data, size * 2 if held else size
            continue
        found, held = held[:cut].split(b"\n"), held[cut + 1 :]
        if at + cut + 1 > end:
            here, kept = at, 0
            while kept < len(found) and here < end:
                here += len(found[kept]) + 1
                kept += 1
            found, held = found[:kept], b""
            at = max(here, end)
        else:
            at += cut + 1
        yield _line_batch(start, place, found)
        place += len(found)


def _line_batch(block: int, place: int, found: list[bytes]) -> pa.RecordBatch:
    text = pa.array([x.decode("utf-8", "replace") for x in found], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(np.arange(place, place + len(found))), text], names=["block", "place", "line"])


def with_ordinal(df: DataFrame) -> DataFrame:
    """(_ordinal, line) of fixed_lines: blocks' lines are counted, and numbered within their block.

    What is broadcast is named: Spark takes the size of lines that come from Python for that of the list of ranges, and
    would send them all to the driver. The counts are a row for each SPLIT bytes of the file.
    """
    counts = df.groupBy("block").count()
    before = counts.select("block", (F.sum("count").over(Window.orderBy("block")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    return df.withColumn("own", own).join(F.broadcast(before), "block").select((F.col("before") + F.col("own")).alias("_ordinal"), "line")


def checked_lines(spark: SparkSession, path: str, strict: bool) -> tuple[DataFrame, int]:
    """Fixed lines that are JSON objects, and how many aren't; strict raises on the first such line's number."""
    found = fixed_lines(spark, path).withColumn("ok", profile.is_json_object(F.col("line")))
    told = found.groupBy("block").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.min(F.when(~F.col("ok"), F.col("place"))).alias("first"))
    # Ranges with bad lines: no more than the file has bytes / SPLIT.
    bad = told.where("bad > 0").orderBy("block").collect()
    if bad and strict:
        first = bad[0]
        before = (F.col("block") < first.block) | ((F.col("block") == first.block) & (F.col("place") < first["first"]))
        raise ConversionError(f"record {found.where(before).count() + 1} isn't a JSON object")
    return found.where("ok").drop("ok"), sum(r.bad for r in bad)


def _python_records(spark: SparkSession, path: str, parse: Callable) -> DataFrame:
    """Records of a file that one task parses as a stream (its format can't be split)."""
    path = str(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                held: list[tuple[int, str]] = []
                filesystem, name = files.at(p)
                with filesystem.open_input_file(name) as f:
                    for n, record in enumerate(parse(f)):
                        held.append((n, json.dumps(record, ensure_ascii=False)))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held])], names=["_ordinal", "record"])
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held])], names=["_ordinal", "record"])

    return spark.range(1, numPartitions=1).select(F.lit(path).alias("p")).mapInArrow(run, "_ordinal long, record string")


class _Text:
    """A growing window over a UTF-8 stream: text from at on; drop() forgets what is before."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size, self.decoder = source, size, codecs.getincrementaldecoder("utf-8-sig")()
        self.text, self.at, self.ended = "", 0, False

    def more(self, size: int | None = None) -> bool:
        data = b"" if self.ended else self.source.read(size or self.size)
        self.ended = self.ended or not data
        self.text = self.text[self.at :] + self.decoder.decode(data, final=not data)
        self.at = 0
        return bool(data)

    def peek(self) -> str:
        """The next character that isn't white space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""


def array_items(source, size: int = 1 << 20) -> Iterator[dict]:
    """Objects of a JSON array read as a stream: memory of a chunk and of the largest object."""
    text, decoder, n = _Text(source, size), json.JSONDecoder(), 0
    if not text.peek():
        raise ConversionError("the JSON file is empty")
    if text.peek() != "[":
        raise ConversionError("the JSON file isn't an array")
    text.at += 1
    if text.peek() == "]":
        text.at += 1
    else:
        while True:
            n, step = n + 1, size
            if not text.peek():
                raise ConversionError("the JSON array isn't closed")
            while True:
                try:
                    record, end = decoder.raw_decode(text.text, text.at)
                    # A number or word may go on in the next chunk; only brackets and quotes end for sure.
                    if end < len(text.text) or text.ended or isinstance(record, (dict, list, str)):
                        break
                except json.JSONDecodeError:
                    if text.ended:
                        raise ConversionError(f"record {n} isn't JSON, or the array isn't closed") from None
                step *= 2
                text.more(step)
            text.at = end
            if not isinstance(record, dict):
                raise ConversionError(f"record {n} isn't a JSON object")
            yield record
            mark = text.peek()
            if mark not in (",", "]"):
                raise ConversionError(f"a comma is missing after record {n}" if mark else "the JSON array isn't closed")
            text.at += 1
            if mark == "]":
                break
    if text.peek():
        raise ConversionError("data follow the JSON array")


def csv_value(cell: str | None, dbf_type: str | None):
    """A cell's value: empty is null; text types may hold a JSON string, others any JSON value."""
    if cell is None or cell == "":
        return None
    if dbf_type in TEXT_TYPES and not cell.startswith('"'):
        return cell
    try:
        value = json.loads(cell)
    except ValueError:
        return cell
    return cell if dbf_type in TEXT_TYPES and not isinstance(value, str) else value


#: Reserved keys of exported records whose cells are text.
TEXT_KEYS = ("_raw_record",)


def read_records(spark: SparkSession, path: str, input_format: str, sidecar: Mapping | None = None) -> DataFrame:
    """(_ordinal, record) of an exported file."""
    if input_format == "jsonl":
        good, _ = checked_lines(spark, path, strict=True)
        return with_ordinal(good).withColumnRenamed("line", "record")
    if input_format == "json":
        if files.read_bytes(path, 2) == b"[\n":
            body = fixed_lines(spark, path).withColumn("line", F.regexp_replace(F.trim("line"), ",$", "")).where(~F.col("line").isin("[", "]", "[]"))
            bad = body.where(~profile.is_json_object(F.col("line")))
            if bad.isEmpty():
                return with_ordinal(body).withColumnRenamed("line", "record")
        return _python_records(spark, path, array_items)
    if input_format == "csv":
        kinds = {f["name"]: f["dbf_type"] for f in (sidecar or {}).get("fields", [])} | dict.fromkeys(TEXT_KEYS, "C")
        rows = spark.read.csv(str(path), header=True, multiLine=True, escape='"', quote='"', nullValue="", emptyValue="", inferSchema=False)

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [json.dumps({k: csv_value(v, kinds.get(k)) for k, v in r.items() if k != "_place"}, ensure_ascii=False) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_place")), pa.array(out, pa.string())], names=["_ordinal", "record"])

        return rows.withColumn("_place", F.monotonically_increasing_id()).mapInArrow(typed, "_ordinal long, record string")
    if input_format == "xlsx":
        return _python_records(spark, path, xlsx.records)
    raise ValueError(f"unknown input format: {input_format}")


def csv_faults(source) -> tuple[int, list[str]]:
    """Records of a CSV stream, and what is wrong with it: bad quoting, rows wider or narrower than the header."""
    reader, n, head = csv.reader(io.TextIOWrapper(source, "utf-8-sig", newline=""), strict=True), 0, None
    found: list[str] = []
    try:
        for row in reader:
            if head is None:
                head = len(row)
                continue
            n += 1
            if len(row) != head and len(found) < 5:
                found.append(f"record {n} has {len(row)} cells, the header {head}")
    except (csv.Error, UnicodeDecodeError) as e:
        found.append(f"after record {n}: {type(e).__name__}")
    return n, found if head is not None else ["the file has no header"]


def count_records(spark: SparkSession, path: str, output_format: str) -> tuple[int, list[str]]:
    """Records of an exported file and what is wrong with its syntax."""
    try:
        if output_format == "jsonl":
            row = profile.line_counts(lines(spark, path), "line").first()
            return row.records, [f"{row.skipped_invalid} lines aren't JSON objects"] if row.skipped_invalid else []
        if output_format == "csv":
            return _csv_count(spark, path)
        return read_records(spark, path, output_format).count(), []
    except Exception as e:  # noqa: BLE001  any defect of the file is the check's result
        return 0, [f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"]


def _csv_count(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """csv_faults by a task that streams the file: quotes may hold line ends, so its syntax is one pass in order."""
    path = str(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            filesystem, p = files.at(path)
            with filesystem.open_input_file(p) as f:
                n, found = csv_faults(f)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([found], pa.list_(pa.string()))], names=["n", "faults"])

    row = spark.range(1, numPartitions=1).mapInArrow(run, "n long, faults array<string>").first()
    return row.n, list(row.faults)


@dataclass(frozen=True)
class ConversionProgress:
    """How far a conversion has come: tasks done of those known so far, and the seconds since its start."""

    source: str
    destination: str
    tasks_done: int
    tasks: int
    seconds: float

    @property
    def percent(self) -> float:
        return 100.0 * self.tasks_done / self.tasks if self.tasks else 0.0


def _watched(spark: SparkSession, work: Callable[[], object], cancel: Callable[[], bool] | None, progress: Callable | None, source: str, destination: str):
    """work(), its Spark jobs stopped as soon as cancel() says so, and reported to progress while they run."""
    if cancel is None and progress is None:
        return work()
    if cancel and cancel():
        raise ConversionCancelled("cancelled by the caller")
    context, tag, began, done = spark.sparkContext, f"strataline-{uuid.uuid4().hex}", time.perf_counter(), {}

    def run() -> None:
        context.setJobGroup(tag, "conversion", interruptOnCancel=True)
        try:
            done["value"] = work()
        except BaseException as e:  # noqa: BLE001  raised again below
            done["error"] = e

    def report(ended: bool = False) -> None:
        if progress:
            tracker = context.statusTracker()
            stages = [x for j in tracker.getJobIdsForGroup(tag) if (info := tracker.getJobInfo(j)) for x in (tracker.getStageInfo(k) for k in info.stageIds) if x]
            tasks = sum(x.numTasks for x in stages)
            # The tracker hears of tasks a little later than they end.
            done_tasks = max(1, tasks) if ended else sum(x.numCompletedTasks for x in stages)
            progress(ConversionProgress(str(source), str(destination), done_tasks, max(done_tasks, tasks), time.perf_counter() - began))

    worker = InheritableThread(target=run)
    worker.start()
    stopped = False
    while worker.is_alive():
        worker.join(POLL)
        if worker.is_alive() and not stopped and cancel and cancel():
            context.cancelJobGroup(tag)
            stopped = True
        report()
    if stopped:
        raise ConversionCancelled("cancelled by the caller")
    if "error" in done:
        raise done["error"]
    report(ended=True)
    return done["value"]


def _streamed(spark: SparkSession, source: str, destination: str, text_of: Callable[[DataFrame], DataFrame], strict: bool, overwrite: bool, head: bytes, between: str, tail: bytes, empty: bytes) -> tuple[int, int]:
    """One pass from a JSONL file's splits to a file: text_of makes the text of checked lines, null where a line is bad."""
    files.ensure_free(destination, overwrite)
    folder = f"{destination}.parts-{uuid.uuid4().hex[:8]}"
    try:
        checked = lines(spark, source).withColumn("line", F.when(profile.is_json_object(F.col("line")), F.col("line")))
        parts = files.stage_blocks(text_of(checked), folder, between)
        bad = sum(p.bad for p in parts)
        if bad and strict:
            before = 0
            for p in parts:
                if p.bad:
                    raise ConversionError(f"record {before + p.first_bad + 1} isn't a JSON object")
                before += p.n
        files.joined_parts(destination, folder, [p.name for p in parts if p.n], head, between.encode(), tail, empty, overwrite)
        return sum(p.n for p in parts), bad
    finally:
        files.drop_folder(folder)


def jsonl_to_json(spark: SparkSession, source: str, destination: str, *, strict: bool = True, overwrite: bool = True, cancel: Callable[[], bool] | None = None, progress: Callable | None = None) -> ConversionStats:
    """JSON array of the lines' own bytes, a record a line; one pass, without a shuffle."""
    began = time.perf_counter()
    work = lambda: _streamed(spark, source, destination, lambda df: df, strict, overwrite, b"[\n", ",\n", b"\n]\n", b"[]\n")
    n, bad = _watched(spark, work, cancel, progress, source, destination)
    return _stats(source, destination, n, bad, began)


def inferred_columns(good: DataFrame) -> list[tuple[str, str]]:
    """(column, kinds) in the order in which columns first come up."""
    keys = good.select("block", "place", "line", F.posexplode(F.json_object_keys("line")).alias("pos", "key"))
    order = keys.groupBy("key").agg(F.min(F.struct("block", "place", "pos")).alias("first"))
    kinds = profile.json_columns(good, "line", "place").select("key", "kinds")
    return [(r.key, r.kinds) for r in order.join(kinds, "key").orderBy("first").collect()]


def _column_type(kinds: str) -> str:
    """Column type that holds kinds without change of text."""
    found = set(kinds.split(",")) - {"null"}
    return "boolean" if found == {"bool"} else "bigint" if found == {"int"} else "string"


def flattened(record: Mapping, prefix: str = "") -> dict:
    """Nested objects under dotted names; arrays stay, empty objects vanish."""
    out: dict = {}
    for k, v in record.items():
        if isinstance(v, Mapping):
            out |= flattened(v, f"{prefix}{k}.")
        else:
            out[prefix + k] = v
    return out


def flat_lines(good: DataFrame) -> DataFrame:
    """Lines with nested objects flattened; their depth isn't known before, so this runs in Arrow batches. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [x and json.dumps(flattened(json.loads(x)), ensure_ascii=False, separators=(",", ":")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.string())], names=["block", "place", "line"])

    return good.select("block", "place", "line").mapInArrow(run, "block long, place long, line string")


def _declared(value, kind: str, name: str):
    """A cell's text, which must be of the declared kind; an error names the column, never the value."""
    fits = {"boolean": value.isin("true", "false"), "bigint": value.rlike(r"^-?[0-9]+(\.0+)?$"), "double": value.try_cast("double").isNotNull()}.get(kind)
    if fits is None:
        return value
    return F.when(value.isNull() | fits, value).otherwise(F.raise_error(F.lit(f"column {name!r} has a value that isn't {kind}")).cast("string"))


def jsonl_to_csv(spark: SparkSession, source: str, destination: str, *, columns: Sequence[str] | None = None, schema_types: Mapping[str, str] | None = None, null_columns: Sequence[str] = (), separator: str = ",", include_bom: bool = False, strict: bool = True, flatten: bool = False, overwrite: bool = True, tell_empty: bool = False, cancel: Callable[[], bool] | None = None, progress: Callable | None = None) -> ConversionStats:
    """CSV with a header: configured columns, then further ones as they come up; null is an empty cell.

    One pass where all columns are declared, else one more before it for the columns. Declared kinds are checked. With
    tell_empty an empty text, which would read as null, and one that begins with a quote are JSON strings.
    """
    began = time.perf_counter()
    if len(separator) != 1:
        raise ValueError("the separator is one character")
    unknown = {k for k in (schema_types or {}).values() if k not in KINDS}
    if unknown:
        raise ValueError(f"unknown column types: {sorted(unknown)}")
    declared = {c: KINDS[k] for c, k in (schema_types or {}).items()}

    def work() -> tuple[int, int, list[str], dict[str, str]]:
        files.ensure_free(destination, overwrite)
        if columns and set(columns) <= set(declared):
            types, order = {c: declared[c] for c in columns}, list(columns)
        else:
            checked = lines(spark, source).withColumn("line", F.when(profile.is_json_object(F.col("line")), F.col("line")))
            found = inferred_columns((flat_lines(checked) if flatten else checked).where("line IS NOT NULL"))
            types = {c: _column_type(k) for c, k in found} | declared
            order = policies.merge_columns(columns or (), [c for c, _ in found])
        schema = T.StructType([T.StructField(c, T.StringType()) for c in order])

        def cell(c: str):
            if c in null_columns:
                return F.lit("")
            value = F.col("r").getField(c)
            value = _declared(value, declared[c], c) if c in declared else value
            if tell_empty and declared.get(c, "string") == "string":
                quoted = F.to_json(F.array(value))
                value = F.when((value == "") | value.startswith('"'), F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(value)
            return _quoted(F.coalesce(value, F.lit("")), separator)

        def text_of(df: DataFrame) -> DataFrame:
            parsed = (flat_lines(df) if flatten else df).select("block", "line", F.from_json("line", schema).alias("r"))
            return parsed.select("block", F.when(F.col("line").isNotNull(), F.concat_ws(separator, *(cell(c) for c in order))).alias("line"))

        head = (separator.join(_quoted_text(c, separator) for c in order)).encode()
        start = b"\xef\xbb\xbf" if include_bom else b""
        n, bad = _streamed(spark, source, destination, text_of, strict, overwrite, start + head + b"\n", "\n", b"\n", start + head + b"\n")
        return n, bad, order, types

    n, bad, order, types = _watched(spark, work, cancel, progress, source, destination)
    stats = _stats(source, destination, n, bad, began)
    stats.columns = [f"{c}:{types.get(c, 'string')}" for c in order]
    return stats


def _quoted(text, separator: str):
    """A cell in RFC 4180 quotes if it needs them."""
    needs = text.contains('"') | text.contains("\r") | text.contains("\n") | text.contains(separator)
    return F.when(needs, F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def _quoted_text(text: str, separator: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ('"', "\r", "\n", separator)) else text


def jsonl_to_xlsx(spark: SparkSession, source: str, destination: str, *, columns: Sequence[str] | None = None, strict: bool = True, flatten: bool = False, overwrite: bool = True, max_rows_per_sheet: int = xlsx.MAX_ROWS, long_text: str = "overflow", cancel: Callable[[], bool] | None = None, progress: Callable | None = None) -> ConversionStats:
    """Workbook with a sheet for each max_rows_per_sheet rows (its header included) and long texts on sheets of their own.

    Tasks write sheet XML for ranges of rows; the driver streams the parts into the archive.
    """
    began = time.perf_counter()
    if not 2 <= max_rows_per_sheet <= xlsx.MAX_ROWS:
        raise ValueError("rows per sheet out of range")
    if long_text not in ("overflow", "error"):
        raise ValueError(f"unknown policy for long texts: {long_text}")
    work = lambda: _workbook(spark, source, destination, columns, strict, flatten, overwrite, max_rows_per_sheet, long_text, began)
    return _watched(spark, work, cancel, progress, source, destination)


def _workbook(spark: SparkSession, source: str, destination: str, columns: Sequence[str] | None, strict: bool, flatten: bool, overwrite: bool, max_rows_per_sheet: int, long_text: str, began: float) -> ConversionStats:
    files.ensure_free(destination, overwrite)
    good, bad = checked_lines(spark, source, strict)
    if flatten:
        good = flat_lines(good)
    order = policies.merge_columns(columns or (), [c for c, _ in inferred_columns(good)])
    if len(order) > xlsx.MAX_COLUMNS:
        raise ConversionError(f"{len(order)} columns don't fit a sheet")
    data = max_rows_per_sheet - 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, longs = [], []
            for ordinal, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record, row, out = json.loads(line), ordinal % data + 2, []
                for k, c in enumerate(order):
                    v = record.get(c)
                    if isinstance(v, (dict, list)):
                        v = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
                    elif isinstance(v, int) and not isinstance(v, bool) and abs(v) > 2**53:
                        v = str(v)
                    if isinstance(v, str) and len(v) * 2 > xlsx.MAX_UNITS and len(v.encode("utf-16-le")) // 2 > xlsx.MAX_UNITS:
                        if long_text == "error":
                            raise ConversionError(f"record {ordinal + 1}: column {c!r} is too long for a cell")
                        # Ids follow rows and columns, so every task knows them.
                        number = ordinal * len(order) + k + 1
                        parts = overflow.utf16_parts(v)
                        longs += [json.dumps([number, xlsx.DATA_SHEET.format(ordinal // data + 1), row, ordinal + 1, c, "string", p, len(parts), t]) for p, t in enumerate(parts, 1)]
                        v = xlsx.MARKER.format(number)
                    out.append(v)
                rows.append(xlsx.row_xml(row, out) if any(v is not None for v in out) else f'<row r="{row}">{xlsx.cell(row, 0, None)}</row>')
                longs.append(None)
            at = iter(batch.column(0).to_pylist())
            texts, current = [], []
            for x in longs:
                if x is None:
                    texts.append((next(at), current))
                    current = []
                else:
                    current.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts], pa.int64()), pa.array(rows, pa.string()), pa.array([t[1] for t in texts], pa.list_(pa.string()))], names=["_ordinal", "xml", "longs"])

    sheets = with_ordinal(good).mapInArrow(cells, "_ordinal long, xml string, longs array<string>").persist()
    folder = f"{destination}.sheets"
    filesystem, p = files.at(folder)
    try:
        parts = files.stage_lines(sheets, "xml", ["_ordinal"], folder)
        records = sum(n for *_, n in parts)
        exploded = sheets.select("_ordinal", F.posexplode("longs").alias("pos", "long"))
        long_parts = files.stage_lines(exploded, "long", ["_ordinal", "pos"], folder)

        def lines_of(found) -> Iterator[str]:
            for _, name, _ in found:
                with filesystem.open_input_stream(f"{p}/{name}", compression=None) as f:
                    yield from (x.rstrip("\n") for x in io.TextIOWrapper(f, "utf-8", newline="\n"))

        def sheet(source: Iterator[str], head: Sequence[str], rows: int) -> Iterator[bytes]:
            yield (xlsx.SHEET_HEAD + xlsx.row_xml(1, head)).encode()
            for _, xml in zip(range(rows), source, strict=False):
                yield xml.encode()
            yield xlsx.SHEET_TAIL.encode()

        def long_rows() -> Iterator[str]:
            for k, text in enumerate(lines_of(long_parts)):
                yield xlsx.row_xml(k % (xlsx.MAX_ROWS - 1) + 2, json.loads(text))

        n_long = sum(n for *_, n in long_parts)
        count, long_count = max(1, -(-records // data)), -(-n_long // (xlsx.MAX_ROWS - 1))
        body, texts = lines_of(parts), long_rows()
        named = [(xlsx.DATA_SHEET.format(k + 1), sheet(body, order, data)) for k in range(count)]
        named += [(xlsx.TEXT_SHEET.format(k + 1), sheet(texts, xlsx.OVERFLOW_COLUMNS, xlsx.MAX_ROWS - 1)) for k in range(long_count)]
        target, t = files.at(destination)
        partial = t + ".partial"
        try:
            with target.open_output_stream(partial, compression=None) as out:
                xlsx.workbook(out, named)
            target.move(partial, t)
        except (OSError, ValueError, zipfile.BadZipFile):
            target.delete_file(partial)
            raise
    finally:
        sheets.unpersist()
        if filesystem.get_file_info(p).type != files.fs.FileType.NotFound:
            filesystem.delete_dir(p)
    stats = _stats(source, destination, records, bad, began)
    stats.sheets, stats.overflow_sheets, stats.overflow_parts, stats.columns = count + long_count, long_count, n_long, order
    stats.overflow_values = exploded.where('get_json_object(long, "$[6]") = 1').count() if n_long else 0
    return stats


def _stats(source: str, destination: str, n: int, bad: int, began: float) -> ConversionStats:
    size = lambda p: files.at(p)[0].get_file_info(files.at(p)[1]).size or 0
    return ConversionStats(str(source), str(destination), n, bad, size(source), size(destination), time.perf_counter() - began)


