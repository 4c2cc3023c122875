"""Incremental export: content fingerprints decide which tables are converted again. In-place edits, changed settings and damaged outputs all count."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from strataline.operators import compare, hashing
from strataline.plans import model
from strataline.sources import files

#: The manifest's format name and version.
FORMAT, VERSION = "strataline-checksum-manifest", 1
KEYS = ("relative_path", "dbf_size", "dbf_sha256", "fpt_size", "fpt_sha256", "cdx_size", "cdx_sha256")
_PRINT = "relative_path string, dbf_size long, dbf_sha256 string, fpt_size long, fpt_sha256 string, cdx_size long, cdx_sha256 string"


def fingerprints(spark: SparkSession, tables: list) -> dict[str, dict]:
    """Sizes and hashes of the tables' files by relative path; each file is hashed by a task, as a stream."""
    paths = [p for t in tables for p in (t.path, t.memo, t.index) if p is not None and files.exists(p)]
    found = {r.path: (r.size_bytes, r.sha256) for r in hashing.hashes_of(spark, paths).collect()} if paths else {}
    out = {}
    for t in tables:
        out[t.relative] = {"relative_path": t.relative}
        for name, path in (("dbf", t.path), ("fpt", t.memo), ("cdx", t.index)):
            out[t.relative][f"{name}_size"], out[t.relative][f"{name}_sha256"] = found.get(path, (None, None))
    return out


def load_manifest(output: str) -> tuple[dict | None, str | None]:
    """The manifest, or None and why it can't be used."""
    path = f"{output}/checksum_manifest.json"
    if not files.exists(path):
        return None, None
    try:
        found = json.loads(files.read_bytes(path))
    except ValueError:
        return None, "the checksum manifest can't be read; all tables are converted"
    if found.get("format") != FORMAT or found.get("version") != VERSION:
        return None, "the checksum manifest has another format; all tables are converted"
    return found, None


def output_paths(result: dict, output: str) -> list[str]:
    """The files that a result names, as far as they are there, inside the output."""
    return [result[p] for p in ("output", "schema_output", "deleted_output") if result.get(p) and result[p].startswith(output) and files.exists(result[p])]


def output_is_intact(result: dict, output: str, digests: dict[str, str]) -> bool:
    """Whether a result's files are there with the hashes that it names; digests are those found."""
    for path, digest in (("output", "output_sha256"), ("schema_output", "schema_sha256"), ("deleted_output", "deleted_sha256")):
        if result.get(path):
            try:
                files.safe_relative(result[path].removeprefix(output).lstrip("/"))
            except ValueError:
                return False
            if not result[path].startswith(output) or digests.get(result[path]) is None or digests[result[path]] != result.get(digest):
                return False
    return True


def split(spark: SparkSession, tables: list, prints: dict, manifest: dict | None, options: model.ExportOptions, output: str) -> tuple[list, list]:
    """Tables to convert, and the results to use again."""
    if manifest is None or manifest.get("signature") != json.loads(json.dumps(options.signature())):
        return tables, []
    paths = sorted({p for t in manifest["tables"] for r in t["results"] for p in output_paths(r, output)})
    digests = {r.path: r.sha256 for r in hashing.hashes_of(spark, paths).collect()} if paths else {}
    known = {t["fingerprint"]["relative_path"]: t for t in manifest["tables"] if all(output_is_intact(r, output, digests) for r in t["results"])}
    rows = lambda many: spark.createDataFrame([tuple(p[k] for k in KEYS) for p in many], _PRINT)
    found, old = rows(prints.values()), rows([t["fingerprint"] for t in known.values()])
    again = {r.relative_path for r in compare.to_reuse(found, old, KEYS).select("relative_path").collect()}
    reused = []
    for t in tables:
        if t.relative in again:
            for r in known[t.relative]["results"]:
                reused.append(model.TableResult(**r | {"status": model.SKIPPED}))
    return [t for t in tables if t.relative not in again], reused


def write_manifest(output: str, prints: dict, results: list[model.TableResult], options: model.ExportOptions) -> None:
    """Records the tables of which every format is usable."""
    tables = []
    for name, print_ in prints.items():
        own = [r for r in results if r.table == name]
        usable = {r.format for r in own if r.status in (model.OK, model.WARNING, model.SKIPPED) and not r.errors}
        if own and usable >= set(options.formats):
            tables.append({"fingerprint": print_, "results": [asdict(r) for r in own]})
    files.write_json(f"{output}/checksum_manifest.json", {"format": FORMAT, "version": VERSION, "signature": options.signature(), "tables": tables})
