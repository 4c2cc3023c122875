"""Reconstruction of tables from an export and its sidecars, with canonical and raw comparisons."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import scalars
from strataline.operators import compare, hashing
from strataline.plans import model
from strataline.sources import dbf_sink, files, records, sidecar
from strataline.plans.export import in_order, reason, record_line
from strataline.sources.dbf_source import layout_of, read_table


@dataclass
class ReconstructionResult:
    table: str
    input: str
    output: str | None = None
    status: str = model.OK
    records: int = 0
    canonical_sha256_input: str | None = None
    canonical_sha256_output: str | None = None
    canonical_match: bool | None = None
    dbf_sha256: str | None = None
    dbf_raw_match: bool | None = None
    fpt_sha256: str | None = None
    fpt_raw_match: bool | None = None
    differences: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def canonical(f: dict, value: Column) -> Column:
    """Canonical text of a JSON value (given as text) by its field."""
    kind, decimals = f["dbf_type"], int(f["decimal_count"] or 0)
    if kind in ("N", "F", "I", "+", "Y"):
        scale = 4 if kind == "Y" else 0 if kind in ("I", "+") else decimals
        return scalars.canonical_number(value.cast(f"decimal(38,{min(max(scale, 18), 37)})"), scale)
    if kind in ("B", "O") and not f["is_memo"]:
        return scalars.ieee_little_endian(value.cast("double"))
    if kind == "D":
        return F.left(value, F.lit(10))
    if kind in ("T", "@"):
        return scalars.canonical_datetime(value.cast("timestamp_ntz"))
    if kind == "L":
        word = F.lower(F.trim(value))
        return F.when(word.isin(*scalars.TRUE_WORDS), "true").when(word.isin(*scalars.FALSE_WORDS), "false")
    return value


def canonical_rows(rows: DataFrame, described: dict, memo: str) -> DataFrame:
    """(_ordinal, deleted, one text column a field) of JSON records; null bits and memo policy applied, bitmaps left out."""
    parsed = rows.select("_ordinal", F.parse_json("record").alias("v"))
    get = lambda name: F.try_variant_get("v", f"$['{name}']", "string")
    bitmap = next((f["name"] for f in described["fields"] if f["dbf_type"] == "0"), None)
    nullable = [f["name"] for f in described["fields"] if f["nullable"] and f["dbf_type"] != "0"]
    cells = []
    for f in described["fields"]:
        if f["dbf_type"] == "0":
            continue
        c = canonical(f, get(f["name"]))
        if f["is_memo"] and memo != "inline":
            c = F.lit(None).cast("string")
        if bitmap and f["name"] in nullable:
            bits = scalars.strict_base64(get(bitmap))
            c = F.when(~F.coalesce(scalars.bytes_bit_is_set(bits, nullable.index(f["name"])), F.lit(False)), c)
        cells.append(c.alias(f["name"]))
    return parsed.select("_ordinal", (F.coalesce(get("_deleted"), F.lit("false")) == "true").alias("deleted"), *cells)


def canonical_sha256(rows: DataFrame, described: dict) -> str:
    """Checksum of schema, counts and the ordered lines of active and deleted rows; blind to how the two interleave."""
    fields = [f for f in described["fields"] if f["dbf_type"] != "0"]
    lined = rows.select("_ordinal", F.col("deleted").cast("string").alias("d"), hashing.canonical_line([F.col(f"`{f['name']}`") for f in fields]).alias("line"))
    found = {r.d: (r.rows, r.sha256) for r in hashing.ordered_hash(lined, "d", "_ordinal", "line").collect()}
    nothing = (0, hashlib.sha256().hexdigest())
    envelope = {
        "schema": [[f["ordinal"], f["name"], f["dbf_type"], f["length"], f["decimal_count"], f["flags"]] for f in fields],
        "active": found.get("false", nothing),
        "deleted": found.get("true", nothing),
    }
    return hashlib.sha256(json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def table_records(spark: SparkSession, path: str, memo: str | None, encoding: str) -> DataFrame:
    """(_ordinal, record) of a table file, as its export would be."""
    layout = layout_of(path, encoding)
    scanned = read_table(spark, path, memo, encoding=encoding)
    return scanned.select("_ordinal", record_line(layout, model.ExportOptions(), "inline", True).alias("record"))


def reconstruct_one(spark: SparkSession, source: str, relative: str, output: str, input_format: str, memo: str, overwrite: bool) -> ReconstructionResult:
    result = ReconstructionResult(relative, f"{source}/{relative}")
    try:
        described = sidecar.load(sidecar.sidecar_path(source, relative))
        values_there = described["memo"]["values_in_data_output"]
        if memo == "inline" and described["memo"]["required"] and not values_there:
            raise ValueError("memo values aren't in the export; choose another memo policy")
        result.table = described["relative_path"]
        destination = f"{output}/{files.safe_relative(described['relative_path'])}"
        rows = records.read_records(spark, f"{source}/{relative}", input_format, described)
        rows = rows.persist()
        try:
            result.output, memo_path, result.records = dbf_sink.write_table(rows, described, destination, overwrite, memo == "inline")
            encoding = described["dbf"]["encoding"]
            fields = [f["name"] for f in described["fields"] if f["dbf_type"] != "0"]
            expected = canonical_rows(rows, described, memo)
            actual = canonical_rows(table_records(spark, destination, memo_path, encoding), described, memo)
            result.canonical_sha256_input, result.canonical_sha256_output = canonical_sha256(expected, described), canonical_sha256(actual, described)
            result.canonical_match = result.canonical_sha256_input == result.canonical_sha256_output
            if not result.canonical_match:
                result.differences = [r.asDict() for r in compare.sequence_diff(expected, actual, "_ordinal", ["deleted", *fields], 20).collect()]
                result.errors.append("the rebuilt table's canonical values differ")
        finally:
            rows.unpersist()
        result.dbf_sha256 = files.sha256(destination)
        result.dbf_raw_match = result.dbf_sha256 == described["source"]["sha256"]
        if memo_path:
            result.fpt_sha256 = files.sha256(memo_path)
            result.fpt_raw_match = result.fpt_sha256 == described["memo"]["sha256"] if described["memo"]["sha256"] else None
        if not result.dbf_raw_match or result.fpt_raw_match is False:
            result.warnings.append("the rebuilt files aren't byte for byte the source's")
        result.status = model.FAILED if result.errors else model.WARNING if result.warnings else model.OK
    except Exception as e:  # noqa: BLE001  one table's failure doesn't stop the others
        result.status = model.FAILED
        result.errors.append(reason(e)[:300])
    return result


def reconstruct_tree(spark: SparkSession, source: str, output: str, input_format: str = "jsonl", memo: str = "inline", overwrite: bool = False, progress: Callable | None = None) -> model.Run:
    source, output = str(source).rstrip("/"), str(output).rstrip("/")
    inputs = files.discover_inputs(source, input_format)
    root = files.root_of(source)
    told = (lambda n, relative: progress("reconstruct", n, len(inputs), relative)) if progress else None
    out = in_order(lambda relative: reconstruct_one(spark, root, relative, output, input_format, memo, overwrite), inputs, told)
    run = model.Run(out, exit_code=model.exit_code(out))
    tri = lambda name: {k: sum(getattr(r, name) is v for r in out) for k, v in (("true", True), ("false", False), ("unknown", None))}
    run.summary = {"tables": len(out), "failed": run.failed, "canonical_match": tri("canonical_match"), "dbf_raw_match": tri("dbf_raw_match"), "fpt_raw_match": tri("fpt_raw_match")}
    lines = [{"type": "run", "report_version": 1, **run.summary}, *({"type": "table", **asdict(r)} for r in out)]
    files.write_atomic(f"{output}/reconstruction_report.jsonl", "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
    return run


