"""Round-trip quality: table to JSONL to table to JSONL, compared record by record and byte by byte."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataline.functions import scalars
from strataline.operators import compare
from strataline.plans import export, model, reconstruct
from strataline.sources import files, records, sidecar
from strataline.sources.dbf_source import layout_of

#: The folders that a check keeps.
STAGES = ("01_forward_jsonl", "02_reconstructed_dbf", "03_reexported_jsonl")


@dataclass
class QualityResult:
    table: str
    status: str = model.OK
    records: int = 0
    record_differences: list[dict] = field(default_factory=list)
    dbf: dict = field(default_factory=dict)
    fpt: dict = field(default_factory=dict)
    causes: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _blocks(path: str) -> Iterator[bytes]:
    filesystem, p = files.at(path)
    with filesystem.open_input_stream(p, compression=None) as f:
        while block := f.read(1 << 20):
            yield block


def different_bytes(source: str, rebuilt: str, limit: int) -> list[tuple[int, int | None, int | None]]:
    """The first (offset, byte, byte) at which two files differ; None beyond an end."""
    out, at = [], 0
    for a, b in itertools.zip_longest(_blocks(source), _blocks(rebuilt), fillvalue=b""):
        if a != b:
            for k in range(max(len(a), len(b))):
                x, y = a[k : k + 1], b[k : k + 1]
                if x != y:
                    out.append((at + k, x[0] if x else None, y[0] if y else None))
                    if len(out) == limit:
                        return out
        at += max(len(a), len(b))
    return out


def compared_files(spark: SparkSession, source: str | None, rebuilt: str | None, limit: int, header: tuple[int, int] | None) -> dict:
    """Hashes, and the first differing bytes with the area that each belongs to; header is a table's lengths, None for memos."""
    if source is None or rebuilt is None:
        return {"present": source is not None, "match": source is rebuilt}
    found = different_bytes(source, rebuilt, limit)
    out = {"present": True, "match": not found, "source_sha256": files.sha256(source), "rebuilt_sha256": files.sha256(rebuilt), "first_different": []}
    if found:
        df = spark.createDataFrame(found, "offset long, source int, rebuilt int")
        area = scalars.byte_area(F.col("offset"), *header) if header else scalars.memo_area(F.col("offset"))
        out["first_different"] = [r.asDict() for r in df.withColumn("area", area).orderBy("offset").collect()]
    return out


def check_tree(spark: SparkSession, source: str, output: str, overwrite: bool = False, max_differences: int = 20, progress: Callable | None = None) -> model.Run:
    source, output = str(source).rstrip("/"), str(output).rstrip("/")
    if max_differences < 1:
        raise ValueError("max_differences is at least 1")
    if output == source or output.startswith(source + "/"):
        raise ValueError("the output can't be the source or inside it")
    forward, rebuilt, again = (f"{output}/{s}" for s in STAGES)
    options = model.ExportOptions(formats=("jsonl",), memo="inline", deleted="include", overwrite=overwrite)
    first = {r.table: r for r in export.export_tree(spark, source, forward, options, progress).results}
    middle = {r.table: r for r in reconstruct.reconstruct_tree(spark, forward, rebuilt, "jsonl", "inline", overwrite, progress).results}
    last = {r.table: r for r in export.export_tree(spark, rebuilt, again, options, progress).results}
    out = []
    for table in files.discover_tables(source):
        result = QualityResult(table.relative)
        out.append(result)
        steps = [x.get(table.relative) for x in (first, middle, last)]
        for s in steps:
            result.errors += s.errors if s else ["a step has no result"]
            result.warnings += s.warnings if s else []
        if not result.errors:
            described = sidecar.load(sidecar.sidecar_path(forward, table.relative))
            sides = [records.read_records(spark, s.output, "jsonl") for s in (steps[0], steps[2])]
            result.records = steps[0].records
            result.record_differences = [r.asDict() for r in compare.record_diff(*sides, "_ordinal", "record", max_differences).collect()]
            layout = layout_of(table.path)
            result.dbf = compared_files(spark, table.path, steps[1].output, max_differences, (layout.header_length, layout.record_length))
            memo_there = table.memo and steps[1].fpt_sha256
            memo_path = f"{steps[1].output.rsplit('/', 1)[0]}/{described['memo']['path']}" if memo_there else None
            result.fpt = compared_files(spark, table.memo if layout.memo_fields else None, memo_path, max_differences, None)
            if not result.dbf["match"]:
                areas = F.array(*(F.lit(x["area"]) for x in result.dbf["first_different"]))
                result.causes = spark.range(1).select(compare.probable_causes(areas, F.lit(steps[0].deleted_records)).alias("c")).first().c
        raw = result.dbf.get("match") and result.fpt.get("match", True)
        failed = result.errors or result.record_differences or (steps[1] and steps[1].canonical_match is False)
        result.status = model.FAILED if failed else model.OK if raw and not result.warnings else model.WARNING
    run = model.Run(out, exit_code=model.exit_code(out))
    run.summary = {"tables": len(out), "ok": run.ok, "warning": run.warning, "failed": run.failed}
    files.write_json(f"{output}/quality_report.json", {"report_version": 1, **run.summary, "details": [vars(r) for r in out]})
    return run
