"""Queries that write files, run the engine over them and return what it found, each with the SQL that must give the same rows.

`tree` writes three small tables from supplier, nation and region; the runs over them are done once a session and folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline import api
from strataline.functions import codepages
from strataline.operators import compare, hashing
from strataline.plans import export, incremental, model, quality, verify
from strataline.plans.catalog import _PERTURBED, perturbed_orders, query, table
from strataline.sources import dbf_sink, dbf_source, files, records, sidecar
from strataline.sources import table_format as tf

_DONE: dict = {}
SUPPLIER = (("SUPPKEY", "I", 4, 0, 0), ("NAME", "C", 30, 0, 0), ("NATION", "I", 4, 0, 0), ("ACCTBAL", "N", 12, 2, 0))
NATION = (("NATKEY", "N", 4, 0, 0), ("NAME", "C", 25, 0, 0), ("REGION", "I", 4, 0, 0), ("NOTE", "M", 4, 0, 0))
REGION = (("REGKEY", "N", 4, 0, 0), ("NAME", "C", 25, 0, 0))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """make()'s value, kept for this session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DONE:
        _DONE[key] = make()
    return _DONE[key]


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with SUPPLIER.DBF, geo/nation.dbf and its memo file, and geo/Region.dbf."""

    def make() -> str:
        root = files.workspace(spark, "tree")
        supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("SUPPKEY"), F.col("s_name").alias("NAME"), F.col("s_nationkey").alias("NATION"), F.col("s_acctbal").cast("decimal(15,2)").alias("ACCTBAL"), (F.col("s_suppkey") % 7 == 0).alias("_deleted"))
        note = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.col("n_name"), F.lit(" zażółć\r\n"), F.repeat(F.lit("x"), F.col("n_nationkey"))))
        nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("NATKEY"), F.col("n_name").alias("NAME"), F.col("n_regionkey").alias("REGION"), note.alias("NOTE"), (F.col("n_nationkey") % 5 == 4).alias("_deleted"))
        region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("REGKEY"), F.col("r_name").alias("NAME"))
        dbf_sink.new_table(supplier, list(SUPPLIER), f"{root}/SUPPLIER.DBF", order="SUPPKEY")
        dbf_sink.new_table(nation, list(NATION), f"{root}/geo/nation.dbf", order="NATKEY")
        dbf_sink.new_table(region, list(REGION), f"{root}/geo/Region.dbf", order="REGKEY")
        return root

    return once(spark, sf_dir, "tree", make)


def exported(spark: SparkSession, sf_dir: str) -> tuple[str, model.Run]:
    """The tree exported in all formats, deleted rows apart, memo values inline; a report and a manifest beside."""

    def make() -> tuple[str, model.Run]:
        out = files.workspace(spark, "out")
        return out, api.export_tables(tree(spark, sf_dir), out, spark=spark, formats=model.FORMATS, deleted="separate", memo="inline")

    return once(spark, sf_dir, "exported", make)


def whole_export(spark: SparkSession, sf_dir: str) -> str:
    """The tree exported with its deleted rows."""

    def make() -> str:
        out = files.workspace(spark, "whole")
        api.export_tables(tree(spark, sf_dir), out, spark=spark, formats=model.FORMATS, deleted="include", memo="inline").raise_for_errors()
        return out

    return once(spark, sf_dir, "whole", make)


def rebuilt(spark: SparkSession, sf_dir: str, input_format: str) -> tuple[str, model.Run]:
    def make() -> tuple[str, model.Run]:
        back = files.workspace(spark, f"back-{input_format}")
        return back, api.reconstruct_tables(whole_export(spark, sf_dir), back, spark=spark, input_format=input_format, overwrite=True)

    return once(spark, sf_dir, f"rebuilt {input_format}", make)


_TABLES = """
t AS (SELECT 'SUPPLIER.DBF' AS table_name, count(*) FILTER (s_suppkey % 7 <> 0) AS active, count(*) FILTER (s_suppkey % 7 = 0) AS deleted, 4 AS fields, 1 + 4 + 30 + 4 + 12 AS width, 0 AS notes FROM supplier
  UNION ALL SELECT 'geo/nation.dbf', count(*) FILTER (n_nationkey % 5 <> 4), count(*) FILTER (n_nationkey % 5 = 4), 4, 1 + 4 + 25 + 4 + 4, count(*) FILTER (n_nationkey % 5 <> 4 AND n_nationkey % 3 = 0) FROM nation
  UNION ALL SELECT 'geo/Region.dbf', count(*), 0, 2, 1 + 4 + 25, 0 FROM region),
f AS (SELECT unnest(['jsonl', 'csv', 'json', 'xlsx']) AS format)"""


@query("SELECT * FROM (VALUES ('geo/nation.dbf', 'nation', true, false, 1), ('geo/Region.dbf', 'Region', false, false, 2), ('SUPPLIER.DBF', 'SUPPLIER', false, false, 3)) t(relative, name, has_memo, has_index, place)")
def discovered_tables(spark, sf_dir):
    found = files.discover_tables(tree(spark, sf_dir))
    return spark.createDataFrame([(t.relative, t.name, t.memo is not None, t.index is not None, n) for n, t in enumerate(found, 1)], "relative string, name string, has_memo boolean, has_index boolean, place int")


@query("""SELECT * FROM (VALUES (1, 'NATKEY', 'N', 'Numeric', 4, 0, false, 'number'), (2, 'NAME', 'C', 'Character', 25, 0, false, 'string'), (3, 'REGION', 'I', 'Integer', 4, 0, false, 'number'),
  (4, 'NOTE', 'M', 'Memo', 4, 0, true, 'string')) t(ordinal, name, dbf_type, type_name, length, decimal_count, is_memo, json_type)""")
def sidecar_fields(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    found = sidecar.load(sidecar.sidecar_path(out, "geo/nation.dbf"))
    names = ("ordinal", "name", "dbf_type", "type_name", "length", "decimal_count", "is_memo", "json_type")
    return spark.createDataFrame([tuple(f[n] for n in names) for f in found["fields"]], "ordinal int, name string, dbf_type string, type_name string, length int, decimal_count int, is_memo boolean, json_type string")


@query(f"WITH {_TABLES} SELECT table_name, active + deleted AS records, 32 + 32 * fields + 1 + 263 AS header_length, width AS record_length, 'Microsoft Visual FoxPro' AS family, '0xc8' AS driver, 'cp1250' AS encoding FROM t")
def sidecar_tables(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    rows = []
    for t in files.discover_tables(tree(spark, sf_dir)):
        d = sidecar.load(sidecar.sidecar_path(out, t.relative))["dbf"]
        rows.append((t.relative, d["record_count_from_header"], d["header_length_bytes"], d["record_length_bytes"], d["format_family"], d["language_driver"], d["encoding"]))
    return spark.createDataFrame(rows, "table_name string, records long, header_length int, record_length int, family string, driver string, encoding string")


@query("SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false)) t(id, accepted)")
def sidecar_gate(spark, sf_dir):
    """The sidecar as written, with another version, another format, and without fields."""
    out, _ = exported(spark, sf_dir)
    found = sidecar.load(sidecar.sidecar_path(out, "geo/nation.dbf"))
    rows = []
    for n, changed in enumerate(({}, {"schema_version": 99}, {"schema_format": "another"}, {"fields": []})):
        path = f"{files.workspace(spark, 'gate')}/x_schema.json"
        files.write_json(path, found | changed)
        try:
            sidecar.load(path)
            rows.append((n, True))
        except ValueError:
            rows.append((n, False))
    return spark.createDataFrame(rows, "id int, accepted boolean")


@query(f"WITH {_TABLES} SELECT table_name, format, 'OK' AS status, active AS records, deleted AS deleted_records, notes AS null_notes FROM t, f")
def export_results(spark, sf_dir):
    _, run = exported(spark, sf_dir)
    return spark.createDataFrame([(r.table, r.format, r.status, r.records, r.deleted_records, r.null_counts.get("NOTE", 0)) for r in run.results], "table_name string, format string, status string, records long, deleted_records long, null_notes long")


def _rows_of(spark: SparkSession, path: str, input_format: str, described: dict, schema: str) -> DataFrame:
    return records.read_records(spark, path, input_format, described).select(F.from_json("record", schema).alias("r")).select("r.*")


@query("""SELECT f.format, n_nationkey AS "NATKEY", n_name AS "NAME", n_regionkey AS "REGION", CASE WHEN n_nationkey % 3 <> 0 THEN n_name || ' zażółć' || chr(13) || chr(10) || repeat('x', n_nationkey) END AS "NOTE"
  FROM nation, (SELECT unnest(['jsonl', 'csv', 'json', 'xlsx']) AS format) f WHERE n_nationkey % 5 <> 4""")
def exported_rows(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    described, found = sidecar.load(sidecar.sidecar_path(out, "geo/nation.dbf")), None
    for f in model.FORMATS:
        rows = _rows_of(spark, sidecar.data_path(out, "geo/nation.dbf", f), f, described, "NATKEY int, NAME string, REGION int, NOTE string").withColumn("format", F.lit(f))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("""SELECT s_suppkey AS "SUPPKEY", s_name AS "NAME", true AS _deleted FROM supplier WHERE s_suppkey % 7 = 0""")
def deleted_side_rows(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    return _rows_of(spark, f"{out}/SUPPLIER.deleted.jsonl", "jsonl", {}, "SUPPKEY long, NAME string, _deleted boolean")


@query(f"WITH {_TABLES} SELECT table_name AS \"table\", format, 'OK' AS status, 'cp1250' AS encoding, active AS active_records, deleted AS deleted_records, true AS has_hash, 'spark' AS engine, 0::BIGINT AS errors FROM t, f")
def migration_report(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    report = spark.read.json(f"{out}/migration_report.jsonl").where("type = 'table'")
    return report.select("table", "format", "status", "encoding", "active_records", "deleted_records", (F.length("sha256") == 64).alias("has_hash"), "engine", F.size("errors").cast("long").alias("errors"))


@query(f"WITH {_TABLES} SELECT count(DISTINCT table_name) AS tables, count(*) AS outputs, count(*) AS ok, 0::BIGINT AS failed, 0::BIGINT AS incomplete_tables, 0::BIGINT AS exit_code FROM t, f")
def migration_summary(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    summary = spark.read.json(f"{out}/migration_report.jsonl").where("type = 'summary'")
    return summary.select("tables", "outputs", "ok", "failed", "incomplete_tables", F.col("run.exit_code").alias("exit_code"))


@query(f"WITH {_TABLES} SELECT table_name, (32 + 32 * fields + 1 + 263 + (active + deleted) * width + 1)::BIGINT AS dbf_size, 4::BIGINT AS outputs, table_name = 'geo/nation.dbf' AS has_memo FROM t")
def manifest_entries(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    found, problem = incremental.load_manifest(out)
    rows = [(t["fingerprint"]["relative_path"], t["fingerprint"]["dbf_size"], len(t["results"]), t["fingerprint"]["fpt_sha256"] is not None) for t in found["tables"]] if not problem else []
    return spark.createDataFrame(rows, "table_name string, dbf_size long, outputs long, has_memo boolean")


@query(f"WITH {_TABLES} SELECT table_name, table_name <> 'geo/Region.dbf' AS reused FROM t")
def cached_outputs(spark, sf_dir):
    """An incremental run after one table's output was damaged: the others are used again."""

    def make() -> list[tuple]:
        out = files.workspace(spark, "cache")
        api.export_tables(tree(spark, sf_dir), out, spark=spark)
        files.write_atomic(f"{out}/geo/Region.jsonl", b"damaged")
        again = api.export_tables(tree(spark, sf_dir), out, spark=spark, incremental=True)
        return [(r.table, r.status == model.SKIPPED) for r in again.results]

    return spark.createDataFrame(once(spark, sf_dir, "cached", make), "table_name string, reused boolean")


@query("SELECT * FROM (VALUES ('overwrite', true), ('incremental', true), ('formats', false), ('memo', false), ('deleted', false), ('strip_spaces', false), ('format order', true)) t(changed, same)")
def option_signatures(spark, sf_dir):
    base = model.ExportOptions(formats=("csv", "json"))
    others = {"overwrite": {"overwrite": False}, "incremental": {"incremental": True}, "formats": {"formats": ("csv",)}, "memo": {"memo": "inline"}, "deleted": {"deleted": "include"}, "strip_spaces": {"strip_spaces": True}, "format order": {"formats": ("json", "csv")}}
    return spark.createDataFrame([(k, model.ExportOptions(**({"formats": ("csv", "json")} | v)).signature() == base.signature()) for k, v in others.items()], "changed string, same boolean")


@query("SELECT n_nationkey AS \"NATKEY\", n_name AS \"NAME\", NULL::VARCHAR AS \"NOTE\" FROM nation")
def missing_memo_rows(spark, sf_dir):
    path = f"{tree(spark, sf_dir)}/geo/nation.dbf"
    return dbf_source.read_table(spark, path, missingMemo="null-with-warning").select(F.col("NATKEY").cast("int").alias("NATKEY"), "NAME", "NOTE")


@query("SELECT * FROM (VALUES ('a number', 'record 3: field ''REGKEY'': not a number'), ('a marker', 'record 2: marker b''Z'''), ('the end', 'record 5: cut short'), ('no memo', 'record 2: field ''NOTE'': the memo file is missing')) t(fault, message)")
def parse_errors(spark, sf_dir):
    """What a scan says of damaged tables: the record and the field, never their contents."""
    root, rows = tree(spark, sf_dir), []
    good = files.read_bytes(f"{root}/geo/Region.dbf")
    layout = tf.parse_layout(good)
    at = lambda record: layout.header_length + (record - 1) * layout.record_length
    damaged = {
        "a number": good[: at(3) + 1] + b"x.yz" + good[at(3) + 5 :],
        "a marker": good[: at(2)] + b"Z" + good[at(2) + 1 :],
        "the end": good[: at(6) - 4],
    }
    for fault, data in damaged.items():
        path = f"{files.workspace(spark, 'damaged')}/x.dbf"
        files.write_atomic(path, data)
        rows.append((fault, _failure(lambda p=path: dbf_source.read_table(spark, p).collect())))
    rows.append(("no memo", _failure(lambda: dbf_source.read_table(spark, f"{root}/geo/nation.dbf").collect())))
    return spark.createDataFrame([(f, m.split(": b'x")[0]) for f, m in rows], "fault string, message string")


def _failure(work: Callable[[], object]) -> str:
    try:
        work()
    except Exception as e:  # noqa: BLE001  the message is the result
        return export.reason(e)
    return ""


@query("SELECT * FROM (VALUES ('geo/nation.jsonl', 1), ('geo/Region.jsonl', 2), ('SUPPLIER.jsonl', 3)) t(path, place)")
def discovered_inputs(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    return spark.createDataFrame(list(zip(files.discover_inputs(out, "jsonl"), (1, 2, 3), strict=False)), "path string, place int")


@query(f"WITH {_TABLES} SELECT table_name, format, active AS found, 0::BIGINT AS faults FROM t, f")
def file_record_counts(spark, sf_dir):
    out, run = exported(spark, sf_dir)
    rows = []
    for r in run.results:
        n, faults = records.count_records(spark, r.output, r.format)
        rows.append((r.table, r.format, n, len(faults)))
    return spark.createDataFrame(rows, "table_name string, format string, found long, faults long")


@query("SELECT * FROM (VALUES ('good', 2, 0), ('wide', 2, 1), ('open quote', 1, 1), ('empty', 0, 1)) t(name, records, faults)")
def csv_syntax(spark, sf_dir):
    rows = []
    for name, text in (("good", 'a,b\n1,"x\n""y"""\n2,\n'), ("wide", "a,b\n1,2\n1,2,3\n"), ("open quote", 'a,b\n1,2\n3,"x\n'), ("empty", "")):
        path = f"{files.workspace(spark, 'csv')}/x.csv"
        files.write_atomic(path, text.encode())
        n, faults = records.count_records(spark, path, "csv")
        rows.append((name, n, len(faults)))
    return spark.createDataFrame(rows, "name string, records int, faults int")


@query("SELECT * FROM (VALUES ('written', true, false, 'new'), ('failed', true, false, 'old'), ('refused', true, false, 'old')) t(name, there, partial, body)")
def atomic_writes(spark, sf_dir):
    rows = []

    def broken():
        yield b"half"
        raise OSError("disk")

    for name, chunks, overwrite in (("written", b"new", True), ("failed", broken(), True), ("refused", b"new", False)):
        path = f"{files.workspace(spark, 'atomic')}/x"
        files.write_atomic(path, b"old")
        _failure(lambda p=path, c=chunks, o=overwrite: files.write_atomic(p, c, o))
        rows.append((name, files.exists(path), files.exists(path + ".partial"), files.read_bytes(path).decode()))
    return spark.createDataFrame(rows, "name string, there boolean, partial boolean, body string")


@query("SELECT f.format, t.table_name, true AS canonical_match, true AS dbf_match, t.memo AS fpt_match, t.n AS records FROM (SELECT unnest(['jsonl', 'csv', 'json', 'xlsx']) AS format) f, (SELECT 'SUPPLIER.DBF' AS table_name, NULL::BOOLEAN AS memo, count(*) AS n FROM supplier UNION ALL SELECT 'geo/nation.dbf', true, count(*) FROM nation UNION ALL SELECT 'geo/Region.dbf', NULL, count(*) FROM region) t")
def rebuilt_tables(spark, sf_dir):
    """Every format builds the tables and memo files again, byte for byte."""
    rows = [(f, r.table, r.canonical_match, r.dbf_raw_match, r.fpt_raw_match, r.records) for f in model.FORMATS for r in rebuilt(spark, sf_dir, f)[1].results]
    return spark.createDataFrame(rows, "format string, table_name string, canonical_match boolean, dbf_match boolean, fpt_match boolean, records long")


@query("""SELECT n_nationkey AS "NATKEY", n_name AS "NAME", CASE WHEN n_nationkey % 3 <> 0 THEN n_name || ' zażółć' || chr(13) || chr(10) || repeat('x', n_nationkey) END AS "NOTE", n_nationkey % 5 = 4 AS _deleted FROM nation""")
def rebuilt_rows(spark, sf_dir):
    back, _ = rebuilt(spark, sf_dir, "jsonl")
    return dbf_source.read_table(spark, f"{back}/geo/nation.dbf", f"{back}/geo/nation.fpt").select(F.col("NATKEY").cast("int").alias("NATKEY"), "NAME", "NOTE", "_deleted")


@query("""SELECT n_nationkey AS "NATKEY", n_name AS "NAME", CASE WHEN n_nationkey % 3 <> 0 THEN n_name || ' zażółć' END AS "NOTE" FROM nation""")
def relaid_memo(spark, sf_dir):
    """A table whose memo texts are encoded and laid anew, without record images; its header and block pointers are patched."""
    root, out = tree(spark, sf_dir), files.workspace(spark, "relaid")
    described = sidecar.describe(next(t for t in files.discover_tables(root) if t.name == "nation"))
    note = F.when(F.col("n_nationkey") % 3 != 0, F.concat("n_name", F.lit(" zażółć")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("_ordinal"), F.to_json(F.struct(F.col("n_nationkey").alias("NATKEY"), F.col("n_name").alias("NAME"), F.col("n_regionkey").alias("REGION"), note.alias("NOTE"))).alias("record"))
    path, memo, _ = dbf_sink.write_table(rows, described, f"{out}/nation.dbf")
    return dbf_source.read_table(spark, path, memo).select(F.col("NATKEY").cast("int").alias("NATKEY"), "NAME", "NOTE")


@query("""SELECT n_nationkey AS "KEY", CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE base64(encode(n_name)) END AS "BODY", n_nationkey % 2 = 1 AS is_bytes FROM nation""")
def binary_memo_override(spark, sf_dir):
    """Memo values that hold bytes are marked by record, written as such blocks, and read back as base64."""
    marked = F.when(F.col("n_nationkey") % 2 == 1, F.array(F.lit("BODY")))
    body = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.base64(F.encode("n_name", "UTF-8")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("KEY"), body.alias("BODY"), marked.alias("_binary_memo_fields"))
    path = dbf_sink.new_table(rows, [("KEY", "I", 4, 0, 0), ("BODY", "M", 4, 0, 0)], f"{files.workspace(spark, 'bytes')}/x.dbf", order="KEY")
    back = dbf_source.read_table(spark, path, path[:-4] + ".fpt")
    return back.select("KEY", "BODY", (F.size("_binary_memo_fields") > 0).alias("is_bytes"))


@query("SELECT 'summary' AS kind, 3 AS tables, 0 AS failed, 3 AS matched UNION ALL SELECT 'table', 3, 0, 3")
def reconstruction_report(spark, sf_dir):
    back, _ = rebuilt(spark, sf_dir, "jsonl")
    field = lambda path: F.get_json_object("value", f"$.{path}")
    lines = spark.read.text(f"{back}/reconstruction_report.jsonl")
    run = lines.where(field("type") == "run").select(F.lit("summary").alias("kind"), field("tables").cast("int").alias("tables"), field("failed").cast("int").alias("failed"), field("canonical_match.true").cast("int").alias("matched"))
    of_tables = lines.where(field("type") == "table").agg(F.count("*").cast("int").alias("tables"), F.count_if(field("status") == "FAILED").cast("int").alias("failed"), F.count_if(field("canonical_match") == "true").cast("int").alias("matched"))
    return run.unionByName(of_tables.withColumn("kind", F.lit("table")))


def verified(spark: SparkSession, sf_dir: str) -> model.Run:
    out, _ = exported(spark, sf_dir)
    return once(spark, sf_dir, "verified", lambda: api.verify_export(tree(spark, sf_dir), out, spark=spark))


@query(f"WITH {_TABLES} SELECT table_name, format, 'OK' AS status, active AS expected, active AS found, deleted FROM t, f")
def verified_files(spark, sf_dir):
    rows = [(c.table, x.format, c.status, x.expected, x.found, c.deleted) for c in verified(spark, sf_dir).results for x in c.files]
    return spark.createDataFrame(rows, "table_name string, format string, status string, expected long, found long, deleted long")


@query(f"WITH {_TABLES} SELECT format, count(*) AS files, sum(active)::BIGINT AS records, 0::BIGINT AS errors FROM t, f GROUP BY format")
def verified_totals(spark, sf_dir):
    """Totals by format of the verification report, as written."""
    verified(spark, sf_dir)
    out, _ = exported(spark, sf_dir)
    found = json.loads(files.read_bytes(f"{out}/verification_report.json"))["formats"]
    return spark.createDataFrame([(f, x["files"], x["records"], x["errors"]) for f, x in found.items()], "format string, files long, records long, errors long")


@query("SELECT * FROM (VALUES ('geo/nation.dbf', 'FAILED', 1, 0), ('geo/Region.dbf', 'FAILED', 2, 0), ('SUPPLIER.DBF', 'OK', 0, 0)) t(table_name, status, errors, warnings)")
def verified_damage(spark, sf_dir):
    """A file that is gone, and one with a record too many (its count and its hash differ)."""

    def make() -> list[tuple]:
        out = files.workspace(spark, "verify")
        api.export_tables(tree(spark, sf_dir), out, spark=spark)
        filesystem, p = files.at(f"{out}/geo/nation.jsonl")
        filesystem.delete_file(p)
        path = f"{out}/geo/Region.jsonl"
        files.write_atomic(path, files.read_bytes(path) + b"{}\n")
        run = api.verify_export(tree(spark, sf_dir), out, spark=spark, formats="jsonl")
        return [(c.table, c.status, len(c.errors) + sum(len(x.errors) for x in c.files), len(c.warnings)) for c in run.results]

    return spark.createDataFrame(once(spark, sf_dir, "damage", make), "table_name string, status string, errors int, warnings int")


@query(f"WITH {_TABLES} SELECT table_name, 'OK' AS status, active + deleted AS records, 0 AS differences, true AS dbf_match, true AS fpt_match FROM t")
def quality_results(spark, sf_dir):
    def make() -> list[tuple]:
        run = api.check_quality(tree(spark, sf_dir), files.workspace(spark, "quality"), spark=spark, overwrite=True)
        return [(r.table, r.status, r.records, len(r.record_differences), r.dbf.get("match"), r.fpt.get("match")) for r in run.results]

    return spark.createDataFrame(once(spark, sf_dir, "quality", make), "table_name string, status string, records long, differences int, dbf_match boolean, fpt_match boolean")


@query("""SELECT * FROM (VALUES (3, 118, 120, 'header.last_update'), (40, 0, 7, 'field_descriptors_or_header_padding'), (370, 10, 11, 'record_data[record=1,offset=10]'), (400, 1, NULL, 'record_data[record=2,offset=10]')) t("offset", source, rebuilt, area)""")
def file_differences(spark, sf_dir):
    """The first bytes at which two files differ, the shorter one's end included."""
    folder = files.workspace(spark, "bytes")
    a = bytearray(401)
    a[3], a[370], a[400] = 118, 10, 1
    b = bytearray(a[:400])
    b[3], b[40], b[370] = 120, 7, 11
    files.write_atomic(f"{folder}/a", bytes(a))
    files.write_atomic(f"{folder}/b", bytes(b))
    found = quality.compared_files(spark, f"{folder}/a", f"{folder}/b", 20, (360, 30))
    rows = [(x["offset"], x["source"], x["rebuilt"], x["area"]) for x in found["first_different"]]
    return spark.createDataFrame(rows, "offset int, source int, rebuilt int, area string")


@query("SELECT * FROM (VALUES ('as written', 'OK', 0), ('a record less', 'FAILED', 3), ('another memo', 'FAILED', 1), ('a null name', 'FAILED', 1)) t(change, status, errors)")
def output_validation(spark, sf_dir):
    """An output read again: records, nulls, empty texts and memo hashes must be those of the table."""
    out, run = exported(spark, sf_dir)
    found = next(r for r in run.results if r.format == "jsonl" and r.table == "geo/nation.dbf")
    described, rows = sidecar.load(found.schema_output), []
    lines = [json.loads(x) for x in files.read_bytes(found.output).decode().split("\n") if x]
    changes = {"as written": lines, "a record less": lines[1:], "another memo": [x | {"NOTE": x["NOTE"] and x["NOTE"] + "!"} for x in lines], "a null name": [x | {"NAME": None if n == 1 else x["NAME"]} for n, x in enumerate(lines)]}
    for name, changed in changes.items():
        path = f"{files.workspace(spark, 'valid')}/x.jsonl"
        files.write_atomic(path, "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in changed).encode())
        result = model.TableResult(found.table, "jsonl", output=path, records=found.records, null_counts=found.null_counts, empty_counts=found.empty_counts, memo_hashes=found.memo_hashes)
        export.validate(spark, result, described, "inline")
        rows.append((name, result.status, len(result.errors)))
    return spark.createDataFrame(rows, "change string, status string, errors int")


@query(f"""WITH {_PERTURBED}, o AS (SELECT * FROM orders WHERE o_orderkey % 101 <> 0),
  j AS (SELECT coalesce(o.o_orderkey, p.o_orderkey) AS record, o.o_orderkey AS ok, p.o_orderkey AS pk, o.o_orderstatus AS s1, p.o_orderstatus AS s2, o.o_orderpriority AS p1, p.o_orderpriority AS p2 FROM o FULL JOIN p ON o.o_orderkey = p.o_orderkey),
  d AS (SELECT record, 'extra' AS kind, '<record>' AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual, 0 AS place FROM j WHERE ok IS NULL
    UNION ALL SELECT record, 'field', 'o_orderstatus', s1, s2, 1 FROM j WHERE ok IS NOT NULL AND s1 IS DISTINCT FROM s2 UNION ALL SELECT record, 'field', 'o_orderpriority', p1, p2, 2 FROM j WHERE ok IS NOT NULL AND p1 IS DISTINCT FROM p2)
  SELECT record, kind, field, expected, actual FROM d WHERE record <= (SELECT min(record) FROM d WHERE kind = 'extra') ORDER BY record, place LIMIT 1000000""")
def canonical_diff(spark, sf_dir):
    """Differences of two sequences up to the first record that only one has, fields in the schema's order."""
    expected = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 101 != 0)
    return compare.sequence_diff(expected, perturbed_orders(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_orderpriority"], 1_000_000)


@query("SELECT n_name, octet_length(encode(n_name)) AS size_bytes, sha256(n_name) AS sha256 FROM nation")
def file_digests(spark, sf_dir):
    folder = files.workspace(spark, "digests")
    names = [r.n_name for r in table(spark, sf_dir, "nation").collect()]
    for n in names:
        files.write_atomic(f"{folder}/{n}", n.encode())
    found = hashing.hashes_of(spark, [f"{folder}/{n}" for n in names])
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("n_name"), "size_bytes", "sha256")


@query("SELECT n_nationkey, hex(encode(n_name)) || CASE n_nationkey % 3 WHEN 0 THEN 'B9' WHEN 1 THEN '81' ELSE '' END AS bytes FROM nation")
def encode_fallback(spark, sf_dir):
    """Text goes out by the first encoding that has its letters: cp1250 has a Polish letter, only cp852 a Latin one that is added here."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [codepages.encode(t, ["ascii", "cp1250"] if "ü" not in t else ["ascii", "cp852"]).hex().upper() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["n_nationkey", "bytes"])

    extra = F.element_at(F.array(F.lit("ą"), F.lit("ü"), F.lit("")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", extra).alias("t")).mapInArrow(run, "n_nationkey int, bytes string")


@query("SELECT n_name, n_nationkey % 4 = 0 AS safe FROM nation")
def safe_paths(spark, sf_dir):
    rows = []
    for r in table(spark, sf_dir, "nation").collect():
        path = ("a/{}", "/{}", "../{}", "a/../../{}")[r.n_nationkey % 4].format(r.n_name)
        rows.append((r.n_name, not _failure(lambda p=path: files.safe_relative(p))))
    return spark.createDataFrame(rows, "n_name string, safe boolean")


@query("SELECT * FROM (VALUES ('csv,json,csv', 'csv,json'), (' JSON , xlsx ', 'json,xlsx'), ('', 'error'), ('csv,pdf', 'error')) t(given, formats)")
def format_lists(spark, sf_dir):
    rows = []
    for given in ("csv,json,csv", " JSON , xlsx ", "", "csv,pdf"):
        try:
            rows.append((given, ",".join(model.normal_formats(given))))
        except ValueError:
            rows.append((given, "error"))
    return spark.createDataFrame(rows, "given string, formats string")


@query("SELECT * FROM (VALUES ('supplier', 'SUPPKEY', 'integer'), ('supplier', 'NAME', 'string'), ('supplier', 'NATION', 'integer'), ('supplier', 'ACCTBAL', 'number'), ('nation', 'NATKEY', 'integer'), ('nation', 'NAME', 'string'), ('nation', 'REGION', 'integer'), ('nation', 'NOTE', 'string')) t(name, field, kind)")
def csv_kinds(spark, sf_dir):
    out, _ = exported(spark, sf_dir)
    rows = [(n, f, k) for n, path in (("supplier", "SUPPLIER.DBF"), ("nation", "geo/nation.dbf")) for f, k in sidecar.csv_types(sidecar.load(sidecar.sidecar_path(out, path))).items()]
    return spark.createDataFrame(rows, "name string, field string, kind string")


@query("SELECT * FROM (VALUES ('as declared', 'a,b' || chr(10) || 'true,1' || chr(10) || ',-2' || chr(10)), ('not boolean', 'error'), ('not integer', 'error')) t(name, text)")
def declared_types(spark, sf_dir):
    rows = []
    for name, lines in (("as declared", '{"a":true,"b":1}\n{"b":-2}\n'), ("not boolean", '{"a":"x","b":1}\n'), ("not integer", '{"a":true,"b":1.5}\n')):
        folder = files.workspace(spark, "declared")
        files.write_atomic(f"{folder}/x.jsonl", lines.encode())
        failed = _failure(lambda f=folder: records.jsonl_to_csv(spark, f"{f}/x.jsonl", f"{f}/x.csv", columns=["a", "b"], schema_types={"a": "boolean", "b": "integer"}))
        rows.append((name, "error" if failed else files.read_bytes(f"{folder}/x.csv").decode()))
    return spark.createDataFrame(rows, "name string, text string")


@query("SELECT count(*) AS records, true AS watched, true AS cancelled, false AS left_behind FROM nation")
def conversion_control(spark, sf_dir):
    """Progress is told while a conversion runs; a cancelled one leaves nothing."""
    from strataline.plans.catalog import as_jsonl

    path, told = as_jsonl(spark, table(spark, sf_dir, "nation"), "n_nationkey", "nation"), []
    done = records.jsonl_to_json(spark, path, path + ".json", progress=told.append)
    failed = _failure(lambda: records.jsonl_to_json(spark, path, path + ".no", cancel=lambda: True))
    return spark.createDataFrame([(done.records, bool(told) and told[-1].percent == 100.0, "cancelled" in failed, files.exists(path + ".no"))], "records long, watched boolean, cancelled boolean, left_behind boolean")


@query("SELECT * FROM (VALUES ('ok', 0, true, false), ('warning', 2, false, false), ('failed', 1, false, true)) t(name, exit_code, successful, raises)")
def run_codes(spark, sf_dir):
    rows = []
    for name, status in (("ok", model.OK), ("warning", model.WARNING), ("failed", model.FAILED)):
        results = [model.TableResult("a", "csv"), model.TableResult("b", "csv", status=status)]
        run = model.Run(results, exit_code=model.exit_code(results))
        rows.append((name, run.exit_code, run.successful, bool(_failure(run.raise_for_errors))))
    return spark.createDataFrame(rows, "name string, exit_code int, successful boolean, raises boolean")


@query("SELECT * FROM (VALUES ('export', true), ('reconstruct', true)) t(run, refused)")
def options_or_keywords(spark, sf_dir):
    tries = {
        "export": lambda: api.export_tables("a", "b", spark=spark, options=model.ExportOptions(), memo="inline"),
        "reconstruct": lambda: api.reconstruct_tables("a", "b", spark=spark, options=model.ReconstructionOptions(), memo="inline"),
    }
    return spark.createDataFrame([(k, "together" in _failure(v)) for k, v in tries.items()], "run string, refused boolean")


@query("""SELECT a.key AS key, a.value AS before, b.value AS after FROM (SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey % 2 = 0) a LEFT JOIN (SELECT n_nationkey AS key, lower(n_name) AS value FROM nation WHERE n_nationkey % 3 = 0) b ON a.key = b.key""")
def stage_results(spark, sf_dir):
    """Results of two steps of a run, looked up by table."""
    nation = table(spark, sf_dir, "nation")
    first = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("before"))
    second = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("after"))
    return compare.with_report(first, second, "key").select("key", "before", "after")


@query("SELECT * FROM (VALUES ('SUPPLIER.DBF', 'jsonl', true), ('geo/Region.dbf', 'jsonl', true), ('geo/nation.dbf', 'jsonl', true)) t(table_name, format, known)")
def loaded_report(spark, sf_dir):
    """Entries that verification finds in the migration report, the last of each table and format."""
    out, _ = exported(spark, sf_dir)
    found = verify.load_report(out)
    return spark.createDataFrame([(t, f, bool(e["sha256"])) for (t, f), e in found.items() if f == "jsonl"], "table_name string, format string, known boolean")
