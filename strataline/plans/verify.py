"""Verification of an export against its tables and its migration report."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataline.operators import hashing
from strataline.plans import export, model
from strataline.sources import files, records, sidecar
from strataline.sources.dbf_source import layout_of, read_table


@dataclass
class FileCheck:
    format: str
    path: str
    expected: int | None = None
    found: int | None = None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class TableCheck:
    table: str
    active: int = 0
    deleted: int = 0
    files: list[FileCheck] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def status(self) -> str:
        if self.errors or any(f.errors for f in self.files):
            return model.FAILED
        return model.WARNING if self.warnings or any(f.warnings for f in self.files) else model.OK


def load_report(output: str) -> dict[tuple[str, str], dict] | None:
    """Report entries by (table, format), the last one of each; None without a report."""
    path = f"{output}/migration_report.jsonl"
    if not files.exists(path):
        return None
    out = {}
    for line in files.read_bytes(path).decode().splitlines():
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        if isinstance(entry, dict) and entry.get("type") == "table":
            out[entry["table"], entry["format"]] = entry
    return out


def verify_table(spark: SparkSession, table: files.FoundTable, output: str, formats, report: dict | None, digests: dict[str, str]) -> TableCheck:
    check = TableCheck(table.relative)
    try:
        described = sidecar.load(sidecar.sidecar_path(output, table.relative))
    except (OSError, ValueError) as e:
        check.errors.append(f"sidecar: {e}")
        return check
    layout = layout_of(table.path, described["dbf"]["encoding"])
    if layout.memo_fields and table.memo is None:
        check.warnings.append("the table has memo fields and no memo file")
    row = read_table(spark, table.path, table.memo, encoding=described["dbf"]["encoding"], errors="replace", missingMemo="null-with-warning", columns="-").agg(F.count_if(~F.col("_deleted")), F.count_if("_deleted")).first()
    check.active, check.deleted = row[0], row[1]
    own = [(f.name, f.dbf_type, f.length, f.decimals) for f in layout.fields]
    theirs = [(f["name"], f["dbf_type"], f["length"], f["decimal_count"]) for f in described["fields"]]
    if len(own) != len(theirs):
        check.errors.append(f"the table has {len(own)} fields, the sidecar {len(theirs)}")
    check.errors += [f"field {n}: table {a}, sidecar {b}" for n, (a, b) in enumerate(zip(own, theirs, strict=False), 1) if a != b]
    if table.index:
        check.warnings.append("an index file belongs to the table; it isn't exported")
    for f in formats:
        made = FileCheck(f, sidecar.data_path(output, table.relative, f), check.active)
        check.files.append(made)
        entry = (report or {}).get((table.relative, f))
        if report is not None and entry is None:
            made.warnings.append("the report has no entry")
        # An export that includes deleted rows has them in its data file.
        if entry and entry["active_records"] == check.active + check.deleted:
            made.expected = entry["active_records"]
        if not files.exists(made.path):
            made.errors.append("the file is missing")
            continue
        made.found, problems = records.count_records(spark, made.path, f)
        made.errors += problems
        if not problems and made.found != made.expected:
            made.errors.append(f"{made.found} records, expected {made.expected}")
        if entry and entry.get("sha256") and digests.get(made.path) != entry["sha256"]:
            made.errors.append("the file's hash differs from the report's")
    return check


def verify_tree(spark: SparkSession, source: str, output: str, formats=model.FORMATS, strict: bool = True, report_path: str | None = None, write: bool = True) -> model.Run:
    source, output = str(source).rstrip("/"), str(output).rstrip("/")
    formats = model.normal_formats(formats)
    report = load_report(output)
    tables = files.discover_tables(source)
    there = [p for t in tables for f in formats if files.exists(p := sidecar.data_path(output, t.relative, f))]
    digests = {r.path: r.sha256 for r in hashing.hashes_of(spark, there).collect()} if there else {}
    checks = export.in_order(lambda t: verify_table(spark, t, output, formats, report, digests), tables)
    problems = ["the migration report is missing"] if report is None else []
    totals = {f: {"files": 0, "records": 0, "errors": 0} for f in formats}
    for c in checks:
        for x in c.files:
            totals[x.format]["files"] += x.found is not None
            totals[x.format]["records"] += x.found or 0
            totals[x.format]["errors"] += bool(x.errors)
    run = model.Run(checks, problems, 1 if problems else model.exit_code(checks, strict))
    run.summary = {"tables": len(checks), "failed": run.failed, "warnings": run.warning, "formats": totals, "global_errors": problems}
    if write:
        detail = [{"table": c.table, "status": c.status, "active": c.active, "deleted": c.deleted, "errors": c.errors, "warnings": c.warnings, "files": [vars(x) for x in c.files]} for c in checks]
        files.write_json(report_path or f"{output}/verification_report.json", {**run.summary, "details": detail})
    return run
