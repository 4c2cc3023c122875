"""Scan, export in all formats, rebuild to the same bytes, verify, quality and incremental runs."""

import base64
import datetime as dt
import hashlib
import json
from decimal import Decimal

import pytest

from strataline import api
from strataline.functions import codepages, numbers
from strataline.plans import catalog
from strataline.sources import files, records, xlsx
from strataline.sources import table_format as tf
from strataline.sources.dbf_source import read_table
from tests import tables


def digest(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_scan_reads_types_memo_and_deleted(spark, tmp_path):
    path = tables.build(tmp_path)
    rows = read_table(spark, str(path), str(tmp_path / "example.FPT"), recordsPerPartition=1).orderBy("_ordinal").collect()
    assert [r._deleted for r in rows] == [False, True, False]
    a, b, c = rows
    assert (a.NAME, a.AMOUNT, a.ACTIVE, a.CREATED) == ("Zażółć gęślą", Decimal("1234.50"), True, dt.date(2024, 2, 29))
    assert (a.CHANGED, a.NOTES, a.RATE, a.COST, a.COUNT) == (dt.datetime(2024, 2, 29, 13, 5, 7, 250000), tables.ROWS[0][6], 0.1, Decimal("12.3456"), -5)
    assert bytes(a.PIC) == b"\x00\x01\xff" and b.PIC is None and b.ACTIVE is None and b.AMOUNT == Decimal("-0.25")
    assert c.NOTES == "x" * 700 and c.AMOUNT is None and len(c._raw_record) == len(a._raw_record)


def test_early_end_mark_and_truncation(spark, tmp_path):
    path = tables.build(tmp_path)
    layout = tf.parse_layout(path.read_bytes())
    data = bytearray(path.read_bytes())
    data[layout.header_length + layout.record_length] = 0x1A
    path.write_bytes(data)
    assert read_table(spark, str(path), str(tmp_path / "example.FPT"), recordsPerPartition=1).count() == 1
    tables.build(tmp_path)
    path.write_bytes(path.read_bytes()[:-5])
    with pytest.raises(Exception, match="cut short"):
        read_table(spark, str(path), str(tmp_path / "example.FPT")).collect()


@pytest.mark.parametrize("input_format", ["jsonl", "json"])
def test_rebuild_gives_the_same_bytes(spark, tmp_path, input_format):
    source = tmp_path / "in"
    path = tables.build(source / "sub")
    run = api.export_tables(source, tmp_path / "out", spark=spark, formats=("jsonl", "json"), deleted="include")
    assert [r.status for r in run.results] == ["OK", "OK"], [r.errors + r.warnings for r in run.results]
    again = api.reconstruct_tables(tmp_path / "out", tmp_path / "back", spark=spark, input_format=input_format)
    assert again.results[0].errors == [] and again.results[0].canonical_match is True
    assert digest(tmp_path / "back/sub/example.dbf") == digest(path)
    assert digest(tmp_path / "back/sub/example.FPT") == digest(source / "sub/example.FPT")


@pytest.mark.parametrize("input_format", ["csv", "xlsx"])
def test_rebuild_from_tables_of_cells(spark, tmp_path, input_format):
    source = tmp_path / "in"
    tables.build(source)
    run = api.export_tables(source, tmp_path / "out", spark=spark, formats=(input_format,), deleted="include", memo="inline")
    assert run.exit_code == 0, [r.errors + r.warnings for r in run.results]
    back = api.reconstruct_tables(tmp_path / "out", tmp_path / "back", spark=spark, input_format=input_format).results[0]
    assert back.records == 3 and back.errors == [] and back.canonical_match is True, (back.errors, back.differences)
    assert digest(tmp_path / "back/example.dbf") == digest(source / "example.dbf") and digest(tmp_path / "back/example.FPT") == digest(source / "example.FPT")
    rows = read_table(spark, str(tmp_path / "back/example.dbf"), str(tmp_path / "back/example.FPT")).orderBy("_ordinal").collect()
    assert [r.NOTES for r in rows] == [r[6] for r in tables.ROWS] and [r.COST for r in rows] == [Decimal("12.3456"), Decimal("-0.0001"), Decimal("0")]


def test_policies_reports_and_verify(spark, tmp_path):
    source = tmp_path / "in"
    tables.build(source)
    run = api.export_tables(source, tmp_path / "out", spark=spark, formats="csv,json,xlsx,jsonl", deleted="separate")
    assert run.exit_code == 0 and len(run.results) == 4 and run.summary["complete_tables"] == ["example.dbf"]
    lines = (tmp_path / "out/example.jsonl").read_text().splitlines()
    assert len(lines) == 2 and json.loads(lines[0])["CHANGED"] == "2024-02-29T13:05:07.250000" and json.loads(lines[0])["COST"] == "12.3456"
    assert json.loads((tmp_path / "out/example.deleted.jsonl").read_text())["_deleted"] is True
    assert json.loads((tmp_path / "out/example.json").read_text())[1]["NOTES"] == "x" * 700
    assert (tmp_path / "out/example.csv").read_text().splitlines()[1].split(",")[:2] == ["1", "Zażółć gęślą"]
    assert run.results[0].null_counts["AMOUNT"] == 1 and run.results[0].empty_counts["NAME"] == 1
    checked = api.verify_export(source, tmp_path / "out", spark=spark)
    assert checked.exit_code == 0, [(c.errors, [f.errors for f in c.files]) for c in checked.results]
    (tmp_path / "out/example.json").write_text("[{]")
    assert api.verify_export(source, tmp_path / "out", spark=spark, formats="json").exit_code == 1


def test_failures_are_contained(spark, tmp_path):
    source = tmp_path / "in"
    tables.build(source, "good")
    bad = tables.build(source, "bad")
    data = bytearray(bad.read_bytes())
    data[32 + 11] = ord("W")
    bad.write_bytes(data)
    tables.build(source, "lonely")
    (source / "lonely.FPT").unlink()
    run = api.export_tables(source, tmp_path / "out", spark=spark)
    assert {r.table: r.status for r in run.results} == {"bad.dbf": "UNSUPPORTED", "good.dbf": "OK", "lonely.dbf": "FAILED"} and run.exit_code == 1
    with pytest.raises(Exception, match="memo file is missing"):
        run.raise_for_errors()
    lenient = api.export_tables(source, tmp_path / "out2", spark=spark, missing_memo="null-with-warning")
    assert {r.table: r.status for r in lenient.results}["lonely.dbf"] == "WARNING"
    with pytest.raises(ValueError):
        api.export_tables(source, source / "inside", spark=spark)


def test_incremental_runs(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    tables.build(source, "a")
    tables.build(source, "b")
    export = lambda **k: {r.table: r.status for r in api.export_tables(source, out, spark=spark, incremental=True, **k).results}
    assert export() == {"a.dbf": "OK", "b.dbf": "OK"}
    assert export() == {"a.dbf": "SKIPPED", "b.dbf": "SKIPPED"}
    (out / "a.jsonl").write_text("damaged")
    assert export() == {"a.dbf": "OK", "b.dbf": "SKIPPED"}
    tables.build(source, "b", rows=tables.ROWS[:2])
    assert export() == {"a.dbf": "SKIPPED", "b.dbf": "OK"}
    assert export(deleted="include") == {"a.dbf": "OK", "b.dbf": "OK"}
    (out / "checksum_manifest.json").write_text("{")
    assert export(deleted="include") == {"a.dbf": "OK", "b.dbf": "OK"}


def test_quality(spark, tmp_path):
    tables.build(tmp_path / "in")
    run = api.check_quality(tmp_path / "in", tmp_path / "q", spark=spark)
    assert run.results[0].status == "OK" and run.results[0].dbf["match"] and run.results[0].fpt["match"], vars(run.results[0])


def test_quality_compares_whole_records(spark, tmp_path, monkeypatch):
    """A re-export that differs in a type, in what is beside the fields or in a further key has failed."""
    from pathlib import Path

    from strataline.plans import quality

    real, runs = quality.export.export_tree, []

    def tampered(*args, **options):
        run = real(*args, **options)
        runs.append(run)
        if len(runs) == 2:
            path = Path(run.results[0].output)
            rows = [json.loads(x) for x in path.read_text().splitlines()]
            rows[0]["COUNT"] = str(rows[0]["COUNT"])
            rows[1]["_raw_record"] = base64.b64encode(b"other").decode()
            rows[2] |= {"unexpected": 1, "nothing": None}
            path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        return run

    tables.build(tmp_path / "in")
    monkeypatch.setattr(quality.export, "export_tree", tampered)
    result = api.check_quality(tmp_path / "in", tmp_path / "q", spark=spark).results[0]
    assert [(d["record"], d["field"]) for d in result.record_differences] == [(0, "COUNT"), (1, "_raw_record"), (2, "unexpected")], vars(result)
    assert result.status == "FAILED" and (result.record_differences[0]["expected"], result.record_differences[0]["actual"]) == ("-5", '"-5"')


def test_code_pages_and_numbers():
    assert codepages.decode(b"\x81", "cp1250") == ("ü", True)
    assert codepages.decode("ąę".encode("cp1250"), "cp1250") == ("ąę", False)
    assert "ął".encode("mazovia").decode("piast") == "ął" and "ą".encode("mazovia") == b"\xb1"
    assert codepages.decode(b"\x81", "cp1250", "replace")[0] == "�"
    assert numbers.rendered(Decimal("-0.25"), 4, 2) == b"-.25" and numbers.rendered(Decimal("9E9"), 6, 1).strip() in (b"9.0E+9", b"9E+9")
    assert numbers.rendered(Decimal("0.125"), 6, 2) == b"  0.12"
    with pytest.raises(ValueError):
        numbers.rendered(Decimal("123456"), 3, 0)


def test_jsonl_conversions(spark, tmp_path):
    source = tmp_path / "x.jsonl"
    source.write_text('{"id":1,"text":"a\\u0141,\\"q\\""}\n\n{"id":2,"late":true,"n":{"a":{"b":1}}}\n', encoding="utf-8")
    out = records.jsonl_to_json(spark, str(source), str(tmp_path / "x.json"))
    assert out.records == 2 and json.loads((tmp_path / "x.json").read_text())[1]["late"] is True
    records.jsonl_to_csv(spark, str(source), str(tmp_path / "x.csv"), flatten=True)
    assert (tmp_path / "x.csv").read_text(encoding="utf-8").splitlines() == ["id,text,late,n.a.b", '1,"aŁ,""q""",,', "2,,true,1"]
    source.write_text('{"ok":1}\n{"secret":\n')
    with pytest.raises(records.ConversionError, match="record 2") as e:
        records.jsonl_to_json(spark, str(source), str(tmp_path / "y.json"))
    assert "secret" not in str(e.value) and not (tmp_path / "y.json").exists()
    assert records.jsonl_to_json(spark, str(source), str(tmp_path / "y.json"), strict=False).skipped_invalid == 1
    source.write_text("")
    records.jsonl_to_json(spark, str(source), str(tmp_path / "z.json"))
    assert (tmp_path / "z.json").read_text() == "[]\n"
    with pytest.raises(records.ConversionCancelled):
        records.jsonl_to_json(spark, str(source), str(tmp_path / "z.json"), cancel=lambda: True)


def test_xlsx_sheets_and_long_texts(spark, tmp_path):
    source, long = tmp_path / "x.jsonl", "😀" * 30_000
    rows = [{"id": n, "text": "=1+1\x01_x0041_" if n else long, "n": {"i": n}} for n in range(7)] + [{"id": None, "text": None, "n": None}]
    source.write_text("".join(json.dumps(r) + "\n" for r in rows))
    stats = records.jsonl_to_xlsx(spark, str(source), str(tmp_path / "x.xlsx"), max_rows_per_sheet=4)
    assert (stats.records, stats.overflow_values, stats.overflow_parts, stats.sheets) == (8, 1, 2, 4)
    found = list(xlsx.records((tmp_path / "x.xlsx").read_bytes()))
    assert [r["text"] for r in found] == [r["text"] for r in rows] and found[3]["n"] == '{"i":3}' and found[7]["id"] is None
    with pytest.raises(Exception, match="too long"):
        records.jsonl_to_xlsx(spark, str(source), str(tmp_path / "y.xlsx"), long_text="error")


def test_parts_of_texts_beyond_the_basic_plane(spark):
    from strataline.operators import overflow

    rows = [(1, "😀" * 30), (2, "a" * 25), (3, "a😀" * 10), (4, "short"), (5, None)]
    found = {}
    for r in overflow.parts(spark.createDataFrame(rows, "id int, text string"), "id", "text", 21).collect():
        found.setdefault(r.id, {})[r.part] = (r.parts, r.text)
    assert sorted(found) == [1, 2, 3]
    for k, text in rows[:3]:
        pieces = [found[k][n][1] for n in sorted(found[k])]
        assert "".join(pieces) == text and {p for p, _ in found[k].values()} == {len(pieces)}
        assert all(len(p.encode("utf-16-le")) // 2 <= 21 for p in pieces) and pieces == overflow.utf16_parts(text, 21)


def test_fixed_ranges_and_streamed_arrays(monkeypatch):
    """Line ranges give each line once whatever their size; arrays are read in chunks, and their faults are told."""
    import io
    import random

    r = random.Random(1)
    for _ in range(200):
        data = b"".join(b"x" * r.choice([0, 1, 3, 10, 50]) + b"\n" for _ in range(r.randint(0, 40))) + b"y" * r.choice([0, 5])
        size, got = r.randint(1, 60), []
        for k in range(max(1, -(-len(data) // size))):
            got += [x for b in records._range_lines(io.BytesIO(data), k * size, (k + 1) * size) for x in b.column(2).to_pylist()]
        assert got == data.decode().removesuffix("\n").split("\n")[: len(got)] and "\n".join(got).rstrip("\n") == data.decode().rstrip("\n")
    items = [{"a": i, "t": "]},{[" * (i % 3), "n": {"x": [1, 2, {"y": None}]}} for i in range(50)]
    for size in (1, 3, 17, 1000):
        read = lambda text, n=size: list(records.array_items(io.BytesIO(text.encode()), n))
        assert read(json.dumps(items, indent=1)) == items and read(" [ ] ") == []
        for bad, told in (("", "empty"), ("{}", "isn't an array"), ("[1]", "isn't a JSON object"), ("[{}", "isn't closed"), ("[{} {}]", "comma"), ("[{}] x", "follow"), ("[{},]", "isn't JSON"), ("[12345", "isn't")):
            with pytest.raises(records.ConversionError, match=told):
                read(bad)


def test_line_numbers_stay_whatever_the_split(spark, tmp_path, monkeypatch):
    source = tmp_path / "x.jsonl"
    source.write_text("".join(json.dumps({"n": n, "t": "x" * (n % 50)}) + "\n" for n in range(2000)))
    monkeypatch.setattr(records, "SPLIT", 4096)
    rows = records.read_records(spark, str(source), "jsonl")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        assert [json.loads(r.record)["n"] for r in rows.orderBy("_ordinal").collect()] == list(range(2000))
        records.jsonl_to_json(spark, str(source), str(tmp_path / "x.json"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x["n"] for x in json.loads((tmp_path / "x.json").read_text())] == list(range(2000))
    text = source.read_text().splitlines()
    text[1234] = "{broken"
    source.write_text("\n".join(text))
    with pytest.raises(records.ConversionError, match="record 1235"):
        records.read_records(spark, str(source), "jsonl")


def test_lines_are_never_broadcast(spark, tmp_path, monkeypatch):
    """jsonl_to_json read back 1 GB by sending all lines to the driver; what is broadcast are the counts of the ranges."""
    lines = [json.dumps({"n": n, "t": "x" * 100}) for n in range(5000)]
    (tmp_path / "x.json").write_text("[\n" + ",\n".join(lines) + "\n]\n")
    monkeypatch.setattr(records, "SPLIT", 100_000)
    rows = catalog.read_back(spark, str(tmp_path / "x.json"), "json", "n long, t string")
    assert sorted(r.n for r in rows.collect()) == list(range(5000))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_workers_need_no_copy_of_the_package(tmp_path):
    """An export from another folder, the package on the driver's path only."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    tables.build(tmp_path / "in")
    root = str(Path(__file__).resolve().parents[1])
    code = f"import sys; sys.path.insert(0, {root!r}); from strataline import api; r = api.export_tables({str(tmp_path / 'in')!r}, {str(tmp_path / 'out')!r}, formats='jsonl,csv'); print([x.status + str(x.errors) for x in r.results])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300, check=False)
    assert "['OK[]', 'OK[]']" in done.stdout, done.stderr[-2000:]


def test_discovery_and_paths(tmp_path):
    tables.build(tmp_path / "Sub", "Zed")
    tables.build(tmp_path, "alfa")
    (tmp_path / "ALFA.CDX").write_bytes(b"x")
    found = files.discover_tables(str(tmp_path))
    assert [t.relative for t in found] == ["alfa.dbf", "Sub/Zed.dbf"] and found[0].index.endswith("ALFA.CDX") and found[1].memo.endswith("Zed.FPT")
    for bad in ("/x", "../x", "a/../../b"):
        with pytest.raises(ValueError):
            files.safe_relative(bad)
    assert base64.b64encode(b"") == b""
