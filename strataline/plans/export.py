"""Export of a tree of tables: each is scanned once, written as JSONL, and converted from there."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from pathlib import PurePosixPath

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import scalars
from strataline.operators import compare, hashing, policies, profile
from strataline.plans import incremental, model
from strataline.sources import files, records, sidecar
from strataline.sources import table_format as tf
from strataline.sources.dbf_source import layout_of, read_table

#: Tables that are exported at a time.
PARALLEL = 4
#: Reserved keys of a record that rebuild it byte for byte.
RECORD_KEYS = ("_raw_record", "_raw_text_fields", "_binary_memo_fields")
#: Fields of a report's row, by the result's own names.
REPORT_FIELDS = {
    "table": "table", "output": "output", "status": "status", "encoding": "encoding", "format": "format", "active_records": "records", "deleted_records": "deleted_records",
    "memo_fields": "memo_fields", "null_counts": "null_counts", "empty_string_counts": "empty_counts", "memo_hashes": "memo_hashes", "sha256": "output_sha256", "size_bytes": "output_bytes",
    "schema": "schema_output", "schema_sha256": "schema_sha256", "deleted_output": "deleted_output", "deleted_sha256": "deleted_sha256", "engine": "engine", "sheet_count": "sheets",
    "overflow_value_count": "overflow_values", "overflow_chunk_count": "overflow_parts", "overflow_sheet_count": "overflow_sheets", "elapsed_seconds": "seconds", "warnings": "warnings", "errors": "errors",
}


def serialized(layout: tf.Layout, f: tf.Field, strip: bool) -> Column:
    """A field's value as JSON takes it."""
    c = F.col(f"`{f.name}`")
    kind = f.dbf_type
    if kind == "Y":
        return scalars.decimal_text(c)
    if kind == "D":
        return scalars.iso_date(c)
    if kind in "T@":
        return scalars.iso_datetime(c)
    if layout.is_double(f):
        return scalars.finite(c, f.name)
    if kind == "0" or (layout.is_memo(f) and kind != "M"):
        return scalars.base64_text(c)
    if kind in "NF" and not f.decimals:
        return c.cast("decimal(38,0)")
    return scalars.strip_trailing(c) if strip and kind == "C" else c


def record_line(layout: tf.Layout, options: model.ExportOptions, memo: str, flag: bool) -> Column:
    """JSON line of a row: fields in order, then the reserved keys that it needs."""
    cells = []
    for f in layout.fields:
        c = F.lit(None).cast("string") if layout.is_memo(f) and memo != "inline" else serialized(layout, f, options.strip_spaces)
        cells.append(c.alias(f.name))
    own = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    extra = {"_deleted": F.when(F.lit(flag), F.col("_deleted")), "_raw_record": scalars.base64_text(F.col("_raw_record"))}
    extra["_raw_text_fields"] = F.when(F.size("_raw_text_fields") > 0, F.col("_raw_text_fields"))
    extra["_binary_memo_fields"] = F.when((F.size("_binary_memo_fields") > 0) & F.lit(memo == "inline"), F.col("_binary_memo_fields"))
    rest = F.to_json(F.struct(*(v.alias(k) for k, v in extra.items())))
    return F.concat(F.left(own, F.length(own) - 1), F.when(F.lit(bool(layout.fields)), ",").otherwise(""), F.substring(rest, 2, 2**31 - 1))


def memo_hashes(rows: DataFrame, layout: tf.Layout) -> dict[str, str]:
    """Ordered hash of each memo field's values."""
    kinds = dict(rows.dtypes)
    cells = [(scalars.base64_text(F.col(f"`{n}`")) if kinds[n] == "binary" else F.col(f"`{n}`")).alias(n) for n in layout.memo_fields]
    return text_hashes(rows.select("_ordinal", *cells), layout.memo_fields)


def text_hashes(rows: DataFrame, names) -> dict[str, str]:
    """Ordered hash of each of these text columns, in one job: a group for each column."""
    if not names:
        return {}
    each = F.array(*(F.struct(F.lit(n).alias("g"), scalars.value_payload(F.col(f"`{n}`"), "string").alias("p")) for n in names))
    found = {r.g: r.sha256 for r in hashing.ordered_hash(rows.select("_ordinal", F.inline(each)), "g", "_ordinal", "p").collect()}
    return {n: found.get(n) for n in names}


def export_one(spark: SparkSession, table: files.FoundTable, output: str, options: model.ExportOptions, known: dict | None = None) -> model.TableResult:
    """JSONL, sidecar and separated deleted rows of a table; failures are the result's, not raised."""
    began, result = time.perf_counter(), model.TableResult(table.relative, "jsonl")
    memo = policies.default_memo("jsonl", options.memo)
    try:
        layout = layout_of(table.path, options.encoding, options.decode_errors)
        tf.check_supported(layout)
        result.encoding, result.memo_fields = layout.encoding, layout.memo_fields
        if layout.memo_fields and table.memo is None:
            if options.missing_memo == "fail":
                raise tf.FormatError("the memo file is missing")
            result.warn("the memo file is missing; memo values are null")
        if options.decode_errors != "strict":
            result.warn(f"text is decoded with errors={options.decode_errors}")
        if table.index:
            result.warnings.append("an index file belongs to the table; it isn't exported")
        columns = None if memo == "inline" else ",".join(f.name for f in layout.fields if not layout.is_memo(f)) or None
        scanned = read_table(spark, table.path, table.memo, encoding=options.encoding, errors=options.decode_errors, missingMemo=options.missing_memo, columns=columns).persist()
        try:
            data, deleted = policies.apply_deleted(scanned, options.deleted)
            described = sidecar.describe(table, memo, options.encoding, options.decode_errors, known)
            result.schema_output = sidecar.sidecar_path(output, table.relative)
            files.ensure_free(result.schema_output, options.overwrite)
            result.output = sidecar.data_path(output, table.relative, "jsonl")
            result.deleted_records = scanned.where("_deleted").count()
            line = record_line(layout, options, memo, options.deleted == "include").alias("line")
            result.records = files.write_single(data.select("_ordinal", line), "line", ["_ordinal"], result.output, empty=b"", overwrite=options.overwrite)
            if deleted is not None:
                p = PurePosixPath(result.output)
                result.deleted_output = str(p.with_name(f"{p.stem}.deleted{p.suffix}"))
                marked = deleted.select("_ordinal", record_line(layout, options, memo, True).alias("line"))
                files.write_single(marked, "line", ["_ordinal"], result.deleted_output, empty=b"", overwrite=options.overwrite)
                result.deleted_sha256 = files.sha256(result.deleted_output)
            for r in profile.column_profile(data.select(*(f"`{f.name}`" for f in layout.fields))).collect() if layout.fields else ():
                result.null_counts[r.column_name], result.empty_counts[r.column_name] = r.nulls, r.empties
            result.memo_hashes = memo_hashes(data, layout) if memo == "inline" else {}
            files.write_json(result.schema_output, described)
            result.schema_sha256, result.output_sha256, result.output_bytes = files.sha256(result.schema_output), files.sha256(result.output), files.size(result.output)
            if options.validate:
                validate(spark, result, described, memo)
        finally:
            scanned.unpersist()
    except tf.UnsupportedTable as e:
        result.fail(e, model.UNSUPPORTED)
    except Exception as e:  # noqa: BLE001  one table's failure doesn't stop the others
        result.fail(reason(e))
    result.seconds = time.perf_counter() - began
    return result


def reason(e: Exception) -> str:
    """The format's own message, if the error came from a task."""
    for text in str(e).splitlines():
        if "FormatError: " in text:
            return text.split("FormatError: ", 1)[1]
    return str(e) or type(e).__name__


def validate(spark: SparkSession, result: model.TableResult, described: dict, memo: str) -> None:
    """Reads an output again: its records, nulls, empty texts and memo hashes must be those of the table."""
    fields = [f for f in described["fields"] if not (f["is_memo"] and memo != "inline")]
    found = records.read_records(spark, result.output, result.format, described)
    parsed = found.select("_ordinal", F.parse_json("record").alias("v"))
    value = {f["name"]: F.try_variant_get("v", f"$['{f['name']}']", "string") for f in fields}
    stats = [F.count("*")]
    for c in value.values():
        stats += [F.count_if(c.isNull()), F.count_if(c == "")]
    row = parsed.agg(*stats).first()
    if row[0] != result.records:
        result.fail(f"the output has {row[0]} records, the table {result.records}")
    for n, f in enumerate(fields):
        name, texts = f["name"], f["dbf_type"] in "CVM"
        if row[1 + 2 * n] != result.null_counts[name] or (texts and row[2 + 2 * n] != result.empty_counts[name]):
            result.fail(f"the output's nulls or empty texts of {name!r} differ from the table's")
    named = [f["name"] for f in fields if f["is_memo"]]
    if result.memo_hashes and named:
        again = text_hashes(parsed.select("_ordinal", *(value[n].alias(n) for n in named)), named)
        for name, same in hash_map(spark, {k: result.memo_hashes.get(k) for k in named}, again).items():
            if not same:
                result.fail(f"the output's memo texts of {name!r} differ from the table's")


def hash_map(spark: SparkSession, left: dict, right: dict) -> dict[str, bool]:
    """Whether both sides have the same hash, name by name."""
    rows = spark.createDataFrame([(left, right)], "l map<string,string>, r map<string,string>")
    return compare.hash_matches(rows, "l", "r").first().matches


def convert(spark: SparkSession, source: model.TableResult, output_format: str, output: str, options: model.ExportOptions) -> model.TableResult:
    """Another format of an exported table, from its JSONL."""
    out = model.TableResult(source.table, output_format, schema_output=source.schema_output, schema_sha256=source.schema_sha256, records=source.records, deleted_records=source.deleted_records)
    out.null_counts, out.empty_counts, out.warnings, out.status = dict(source.null_counts), dict(source.empty_counts), list(source.warnings), source.status
    out.encoding, out.memo_fields, out.memo_hashes = source.encoding, source.memo_fields, dict(source.memo_hashes)
    began = time.perf_counter()
    if source.status in (model.FAILED, model.UNSUPPORTED):
        return out.fail("not attempted: the JSONL failed", model.FAILED)
    try:
        described = sidecar.load(source.schema_output)
        names = [f["name"] for f in described["fields"]] + (["_deleted"] if options.deleted == "include" else [])
        # What rebuilds a table byte for byte goes into every format.
        names += [c for c in RECORD_KEYS if c != "_binary_memo_fields" or policies.default_memo(output_format, options.memo) == "inline"]
        out.output = sidecar.data_path(output, source.table, output_format)
        if output_format == "json":
            stats = records.jsonl_to_json(spark, source.output, out.output, overwrite=options.overwrite)
        elif output_format == "csv":
            hidden = described["memo"]["field_names"] if policies.default_memo("csv", options.memo) != "inline" else ()
            types = sidecar.csv_types(described) | ({"_deleted": "boolean"} if options.deleted == "include" else {}) | dict.fromkeys(RECORD_KEYS, "string")
            stats = records.jsonl_to_csv(spark, source.output, out.output, columns=names, schema_types=types, null_columns=hidden, overwrite=options.overwrite, tell_empty=True)
        else:
            stats = records.jsonl_to_xlsx(spark, source.output, out.output, columns=names, overwrite=options.overwrite, long_text=options.xlsx_long_text)
            out.overflow_values, out.overflow_parts, out.sheets, out.overflow_sheets = stats.overflow_values, stats.overflow_parts, stats.sheets, stats.overflow_sheets
        if stats.records != source.records:
            out.fail(f"the output has {stats.records} records, the JSONL {source.records}")
        out.output_sha256, out.output_bytes = files.sha256(out.output), files.size(out.output)
        if options.validate and output_format != "xlsx":
            validate(spark, out, described, policies.default_memo(output_format, options.memo))
    except Exception as e:  # noqa: BLE001
        out.fail(reason(e))
    out.seconds = time.perf_counter() - began
    return out


def in_order(work: Callable, items: list, done: Callable | None = None) -> list:
    """work(item) of all items, PARALLEL at a time in threads of this session, in their order."""
    if len(items) < 2:
        out = [work(x) for x in items]
        if done and items:
            done(1, items[0])
        return out
    with ThreadPoolExecutor(min(PARALLEL, len(items))) as pool:
        wrapped = inheritable_thread_target(SparkSession.getActiveSession() or work)
        wrapped = wrapped(work) if SparkSession.getActiveSession() else wrapped
        futures = {pool.submit(wrapped, x): k for k, x in enumerate(items)}
        for n, future in enumerate(as_completed(futures), 1):
            future.result()
            if done:
                done(n, items[futures[future]])
        return [f.result() for f in futures]


def export_tree(spark: SparkSession, source: str, output: str, options: model.ExportOptions, progress: Callable | None = None) -> model.Run:
    """All tables under source in all formats, with reports; with incremental, only what changed."""
    source, output, began = str(source).rstrip("/"), str(output).rstrip("/"), dt.datetime.now(dt.UTC)
    if output == source or output.startswith(source + "/"):
        raise ValueError("the output can't be the source or inside it")
    tables = files.discover_tables(source)
    run = model.Run([])
    if not tables:
        run.warnings.append("no tables found")
        return run
    convert_these, reused = tables, []
    prints = incremental.fingerprints(spark, tables)
    if options.incremental:
        manifest, problem = incremental.load_manifest(output)
        run.warnings += [problem] if problem else []
        convert_these, reused = incremental.split(spark, tables, prints, manifest, options, output)

    def export_table(table: files.FoundTable) -> list[model.TableResult]:
        first = export_one(spark, table, output, options, prints[table.relative])
        made = {"jsonl": first} | {f: convert(spark, first, f, output, options) for f in options.formats if f != "jsonl"}
        return [made[f] for f in dict.fromkeys(["jsonl", *options.formats])]

    told = (lambda n, table: progress("export", n, len(convert_these), table.relative)) if progress else None
    out = list(reused) + [r for results in in_order(export_table, convert_these, told) for r in results]
    place = {f: k for k, f in enumerate(options.formats)}
    out.sort(key=lambda r: (r.table.lower(), place.get(r.format, len(place))))
    run.results, run.exit_code = out, model.exit_code(out)
    run.summary = roll_up(spark, out, options.formats)
    about = {"source": source, "output": output, "requested_formats": list(options.formats), "options": options.signature(), "started_at": began.isoformat(), "finished_at": dt.datetime.now(dt.UTC).isoformat(), "exit_code": run.exit_code}
    write_reports(output, out, run.summary | {"run": about})
    incremental.write_manifest(output, prints, out, options)
    return run


def roll_up(spark: SparkSession, results: list[model.TableResult], formats) -> dict:
    """Statuses and overflows by format, tables that are complete, and totals."""
    rows = [(r.table, r.format, r.status, len(r.warnings), r.overflow_values, r.overflow_parts, r.overflow_sheets) for r in results]
    df = spark.createDataFrame(rows, "table_name string, format string, status string, n_warnings int, overflow_values long, overflow_chunks long, overflow_sheets long")
    sums = df.groupBy("format").agg(*(F.sum(c).alias(c) for c in ("overflow_values", "overflow_chunks", "overflow_sheets")))
    by_format = {r["format"]: {k: v for k, v in r.asDict().items() if k != "format"} for r in profile.status_rollup(df).join(sums, "format").orderBy("format").collect()}
    complete = [r.table_name for r in profile.complete_tables(df, formats).where("complete").orderBy("table_name").collect()]
    tables = len({r.table for r in results})
    totals = {s.lower(): sum(r.status == s for r in results) for s in (model.OK, model.WARNING, model.SKIPPED, model.FAILED, model.UNSUPPORTED)}
    return {"tables": tables, "outputs": len(results), **totals, "formats": by_format, "complete_tables": complete, "incomplete_tables": tables - len(complete)}


def report_row(result: model.TableResult) -> dict:
    return {name: getattr(result, own) for name, own in REPORT_FIELDS.items()}


def write_reports(output: str, results: list[model.TableResult], summary: dict) -> None:
    rows = [report_row(r) for r in results]
    lines = [{"type": "summary", "report_version": 2, **summary}, *({"type": "table", **r} for r in rows)]
    files.write_atomic(f"{output}/migration_report.jsonl", "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
    text = [",".join(REPORT_FIELDS)] + [",".join(records._quoted_text(v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False), ",") for v in r.values()) for r in rows]
    files.write_atomic(f"{output}/migration_report.csv", ("\n".join(text) + "\n").encode())
