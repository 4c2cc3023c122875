"""The engine's queries over the parquet tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import scalars
from strataline.operators import compare, hashing, ordering, overflow, policies, profile
from strataline.sources import dbf_sink, dbf_source, files, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FORMATS = ("jsonl", "csv", "json", "xlsx")


def query(sql: str | None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a deleted flag."""
    return table(spark, sf_dir, "orders").withColumn("_deleted", F.col("o_orderstatus") == "F")


def perturbed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with some values changed, some rows gone and some added."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    changed = orders.withColumns({
        "o_orderstatus": F.when(key % 97 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_orderpriority": F.when(key % 89 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")),
    }).where(key % 101 != 0)
    return changed.unionByName(orders.where(key % 103 == 0).withColumn("o_orderkey", key + 10_000_000))


_PERTURBED = """
p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 101 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 103 = 0)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each nation and format, statuses by rule; some are lacking."""
    nation = table(spark, sf_dir, "nation")
    rows = nation.crossJoin(F.broadcast(spark.sql("SELECT explode(array('jsonl', 'csv', 'json', 'xlsx')) AS format")))
    place = F.col("n_nationkey") * 7 + F.length("format")
    status = F.element_at(F.array(*map(F.lit, ("OK", "OK", "WARNING", "SKIPPED", "OK", "FAILED", "OK", "OK", "OK", "UNSUPPORTED", "OK"))), (place % 11 + 1).cast("int"))
    out = rows.select(F.col("n_name").alias("table_name"), "format", status.alias("status"), (place % 5).cast("long").alias("n_warnings"), (F.col("n_nationkey") + F.length("format")).cast("long").alias("overflow_values"))
    return out.where(place % 23 != 0)


_RESULTS = """
r AS (SELECT n_name AS table_name, f.format, ['OK', 'OK', 'WARNING', 'SKIPPED', 'OK', 'FAILED', 'OK', 'OK', 'OK', 'UNSUPPORTED', 'OK'][(n_nationkey * 7 + length(f.format)) % 11 + 1] AS status,
    ((n_nationkey * 7 + length(f.format)) % 5)::BIGINT AS n_warnings, (n_nationkey + length(f.format))::BIGINT AS overflow_values
  FROM nation, (SELECT unnest(['jsonl', 'csv', 'json', 'xlsx']) AS format) f WHERE (n_nationkey * 7 + length(f.format)) % 23 <> 0)"""


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, {f'count(*) FILTER ({c} = \'\')' if text else '0'} AS empties FROM {t}"
    for t, c, text in (
        *(("documents", c, c in ("text", "lang", "source")) for c in ("doc_id", "text", "lang", "source", "n_chars")),
        *(("orders", c, c in ("o_orderstatus", "o_orderpriority")) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    )
))
def column_profile(spark, sf_dir):
    parts = [profile.column_profile(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*") for t in ("documents", "orders")]
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS active_index FROM orders WHERE o_orderstatus <> 'F'")
def deleted_skip(spark, sf_dir):
    active, _ = policies.apply_deleted(marked_orders(spark, sf_dir), "skip")
    return ordering.dense_index(active, "o_orderkey", "active_index").select("o_orderkey", "o_custkey", "active_index")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS _deleted, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS physical_index FROM orders")
def deleted_include(spark, sf_dir):
    rows, _ = policies.apply_deleted(marked_orders(spark, sf_dir), "include")
    return ordering.dense_index(rows, "o_orderkey", "physical_index").select("o_orderkey", "_deleted", "physical_index")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'active' END AS branch, count(*) AS n FROM orders GROUP BY 1")
def deleted_separate_counts(spark, sf_dir):
    active, deleted = policies.apply_deleted(marked_orders(spark, sf_dir), "separate")
    return active.agg(F.count("*").alias("n")).select(F.lit("active").alias("branch"), "n").unionByName(deleted.agg(F.count("*").alias("n")).select(F.lit("deleted").alias("branch"), "n"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS _deleted, row_number() OVER (ORDER BY o_orderstatus = 'F', o_orderkey)::BIGINT AS place FROM orders")
def active_then_deleted(spark, sf_dir):
    active, deleted = policies.apply_deleted(marked_orders(spark, sf_dir), "separate")
    count = active.count()
    first = ordering.dense_index(active, "o_orderkey", "place", 1)
    return first.unionByName(ordering.dense_index(deleted, "o_orderkey", "place", count + 1)).select("o_orderkey", "_deleted", "place")


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus = 'F') AS deleted, 6::BIGINT AS fields FROM orders")
def table_stats(spark, sf_dir):
    rows = marked_orders(spark, sf_dir)
    return rows.agg(F.count_if(~F.col("_deleted")).alias("active"), F.count_if("_deleted").alias("deleted")).withColumn("fields", F.lit(len(rows.columns) - 1).cast("long"))


@query("SELECT doc_id, NULL::VARCHAR AS text, lang FROM documents")
def memo_null_policy(spark, sf_dir):
    return policies.apply_memo(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text"], "null")


@query("SELECT doc_id, text, lang FROM documents")
def memo_inline_policy(spark, sf_dir):
    return policies.apply_memo(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text"], policies.default_memo("jsonl", None))


@query("SELECT page_id, regexp_replace(url || ' \t ' || chr(10), '\\s+$', '') AS url FROM pages")
def strip_trailing(spark, sf_dir):
    padded = table(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.lit(" \t \n")))
    return policies.project(padded.withColumn("_deleted", F.lit(False)), ["page_id", "url"], strip=["url"])


@query("""SELECT o_orderkey, o_totalprice::DECIMAL(15, 2)::VARCHAR AS price, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + to_microseconds(250000), '%Y-%m-%dT%H:%M:%S.%f') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS moment,
  base64(encode(o_orderpriority || repeat('x', 60))) AS priority FROM orders""")
def serialize_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    moment = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 0.25 SECOND")).otherwise(F.col("o_orderdate"))
    return orders.select(
        "o_orderkey",
        scalars.decimal_text(F.col("o_totalprice").cast("decimal(15,2)")).alias("price"),
        scalars.iso_date(F.col("o_orderdate")).alias("day"),
        scalars.iso_datetime(moment).alias("moment"),
        scalars.base64_text(F.encode(F.concat("o_orderpriority", F.lit("x" * 60)), "UTF-8")).alias("priority"),
    )


@query("""SELECT l_orderkey, l_partkey, l_linenumber, round_even((l_extendedprice::DECIMAL(15, 2) / 8)::DECIMAL(20, 6), 2)::DECIMAL(20, 2)::VARCHAR AS price,
  round_even((l_quantity::DECIMAL(15, 2) / 4)::DECIMAL(20, 6), 0)::DECIMAL(20, 0)::VARCHAR AS quantity, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') AS shipped FROM lineitem""")
def canonical_values(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    eighth = (F.col("l_extendedprice").cast("decimal(15,2)") / F.lit(8)).cast("decimal(20,6)")
    quarter = (F.col("l_quantity").cast("decimal(15,2)") / F.lit(4)).cast("decimal(20,6)")
    return line.select("l_orderkey", "l_partkey", "l_linenumber", scalars.canonical_number(eighth, 2).alias("price"), scalars.canonical_number(quarter, 0).alias("quantity"), scalars.canonical_datetime(F.col("l_shipdate")).alias("shipped"))


@query("SELECT c_custkey, c_acctbal::DECIMAL(15, 2)::DECIMAL(19, 4)::VARCHAR AS balance FROM customer")
def currency_decimal(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.currency(F.col("c_acctbal").cast("decimal(15,2)")).alias("balance"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL WHEN 3 THEN true WHEN 4 THEN false ELSE NULL END AS flag FROM orders""")
def logical_coercion(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("T", "n", "?", " Yes ", "0", ""))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.logical(word).alias("flag"))


@query("""SELECT p_partkey, CASE WHEN p_size & 1 = 0 THEN p_name END AS p_name, CASE WHEN p_size & 2 = 0 THEN p_brand END AS p_brand,
  CASE WHEN p_size & 4 = 0 THEN p_retailprice END AS p_retailprice FROM part""")
def null_bitmap(spark, sf_dir):
    return policies.null_by_bitmap(table(spark, sf_dir, "part"), "p_size", ["p_name", "p_brand", "p_retailprice"]).select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("""SELECT p_partkey, CASE WHEN p_size & 2 = 0 THEN p_name END AS p_name FROM part""")
def null_bitmap_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("bits", F.unhex(F.lpad(F.hex(F.pmod("p_size", F.lit(256))), 2, "0")))
    return policies.null_by_bitmap(rows.withColumn("unused", F.lit(1)), "bits", ["unused", "p_name"]).select("p_partkey", "p_name")


@query("""SELECT event_id, CASE WHEN event_id = 0 THEN 'header.version' WHEN event_id BETWEEN 1 AND 3 THEN 'header.last_update' WHEN event_id BETWEEN 4 AND 7 THEN 'header.record_count'
  WHEN event_id BETWEEN 8 AND 11 THEN 'header.layout_lengths' WHEN event_id = 14 THEN 'header.incomplete_transaction' WHEN event_id = 15 THEN 'header.encryption'
  WHEN event_id = 28 THEN 'header.structural_index_flag' WHEN event_id = 29 THEN 'header.language_driver' WHEN event_id >= 32 AND event_id < 296 THEN 'field_descriptors_or_header_padding'
  WHEN event_id >= 296 THEN 'record_data[record=' || ((event_id - 296) // 37 + 1) || ',offset=' || ((event_id - 296) % 37) || ']' ELSE 'record_data_or_file_tail' END AS area,
  CASE WHEN event_id <= 3 THEN 'fpt_header.next_free_block' WHEN event_id <= 5 THEN 'fpt_header.reserved' WHEN event_id <= 7 THEN 'fpt_header.block_size' WHEN event_id < 512 THEN 'fpt_header.reserved'
  ELSE 'fpt_memo_block_data_or_padding' END AS memo_area FROM events""")
def binary_area(spark, sf_dir):
    offset = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scalars.byte_area(offset, 296, 37).alias("area"), scalars.memo_area(offset).alias("memo_area"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS \"props.k\" FROM events")
def json_flatten(spark, sf_dir):
    nested = F.to_json(F.struct("event_id", F.from_json("props", "k BIGINT").alias("props")))
    flat = records.flat_lines(table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("block"), F.col("event_id").alias("place"), nested.alias("line")))
    return flat.select(F.from_json("line", "event_id BIGINT, `props.k` BIGINT").alias("r")).select("r.*")


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"k": 1.5, "s": "x"}' ELSE '{"n": null, "b": true}' END AS j FROM events),
  k AS (SELECT event_id, unnest(json_keys(j)) AS key, j FROM e),
  t AS (SELECT event_id, key, CASE json_type(j, '$.' || key) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' ELSE 'null' END AS kind FROM k)
  SELECT key, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, min(event_id) AS first_line FROM t GROUP BY key""")
def json_kinds(spark, sf_dir):
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit('{"k": 1.5, "s": "x"}')).otherwise(F.lit('{"n": null, "b": true}'))
    rows = table(spark, sf_dir, "events").select("event_id", mixed.alias("j"))
    return profile.json_columns(rows, "j", "event_id")


@query("SELECT count(*) FILTER (event_id % 10 > 2) AS records, count(*) FILTER (event_id % 10 IN (0, 1)) AS skipped_invalid FROM events")
def jsonl_invalid_counts(spark, sf_dir):
    last = F.col("event_id") % 10
    line = F.when(last == 0, F.left("props", F.lit(4))).when(last == 1, F.lit("[1]")).when(last == 2, F.lit("  ")).otherwise(F.col("props"))
    return profile.line_counts(table(spark, sf_dir, "events").select(line.alias("line")), "line")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS flag, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_custkey::VARCHAR END AS customer,
  '{"s":"' || o_orderstatus || '","k":' || o_orderkey || '}' AS nested FROM orders""")
def csv_cells(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "F")
    customer = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    nested = F.struct(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("k"))
    return orders.select("o_orderkey", scalars.csv_cell(flag, "boolean").alias("flag"), scalars.csv_cell(customer, "long").alias("customer"), scalars.csv_cell(nested, "struct").alias("nested"))


@query("SELECT doc_id, (length(text) + length(regexp_replace(text || chr(128512), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) + 1)::INTEGER AS units FROM documents")
def utf16_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.utf16_length(F.concat("text", F.lit("\U0001f600"))).alias("units"))


_PARTS = "c AS (SELECT doc_id, text, ceil(length(text) / 1000)::INTEGER AS parts FROM documents WHERE length(text) > 1000), p AS (SELECT doc_id, parts, text, unnest(range(1, parts + 1))::INTEGER AS part FROM c)"


@query(f"WITH {_PARTS} SELECT doc_id, part, parts, substr(text, (part - 1) * 1000 + 1, 1000) AS text FROM p")
def overflow_chunks(spark, sf_dir):
    return overflow.parts(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)


@query("SELECT doc_id, text, true AS complete FROM documents WHERE length(text) > 1000")
def overflow_reassemble(spark, sf_dir):
    return overflow.reassembled(overflow.parts(table(spark, sf_dir, "documents"), "doc_id", "text", 1000), "doc_id")


@query("""SELECT doc_id, CASE WHEN length(text) > 1000 THEN '[[OVERFLOW:' || doc_id || ']]' ELSE text END AS cell, text FROM documents""")
def overflow_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cells = docs.select("doc_id", F.when(F.length("text") > 1000, F.concat(F.lit("[[OVERFLOW:"), F.col("doc_id").cast("string"), F.lit("]]"))).otherwise(F.col("text")).alias("cell"))
    number = F.regexp_extract("cell", r"^\[\[OVERFLOW:([0-9]+)\]\]$", 1)
    keyed = cells.withColumn("overflow_id", F.when(number != "", number.cast("long")))
    texts = overflow.reassembled(overflow.parts(docs, "doc_id", "text", 1000), "doc_id").select(F.col("doc_id").alias("overflow_id"), F.col("text").alias("long"))
    joined = keyed.join(texts, "overflow_id", "left")
    lost = F.raise_error(F.concat(F.lit("no parts of overflow "), F.col("overflow_id").cast("string"))).cast("string")
    return joined.select("doc_id", "cell", F.when(F.col("overflow_id").isNull(), F.col("cell")).otherwise(F.coalesce("long", lost)).alias("text"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 999 + 1)::INTEGER AS sheet, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 999 + 2)::INTEGER AS sheet_row FROM orders")
def sheet_split(spark, sf_dir):
    rows = ordering.dense_index(table(spark, sf_dir, "orders"), "o_orderkey", "i")
    sheet, row = ordering.sheet_place(F.col("i"), 1000)
    return rows.select("o_orderkey", sheet.alias("sheet"), row.alias("sheet_row"))


@query(f"""WITH {_RESULTS} SELECT format, count(*) AS results, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'WARNING') AS warning, count(*) FILTER (status = 'SKIPPED') AS skipped,
  count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'UNSUPPORTED') AS unsupported FROM r GROUP BY format""")
def status_rollup(spark, sf_dir):
    return profile.status_rollup(results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT format, sum(overflow_values)::BIGINT AS overflow_values, sum(n_warnings)::BIGINT AS warnings FROM r GROUP BY format")
def overflow_totals(spark, sf_dir):
    return results(spark, sf_dir).groupBy("format").agg(F.sum("overflow_values").alias("overflow_values"), F.sum("n_warnings").alias("warnings"))


@query(f"WITH {_RESULTS} SELECT table_name, count(DISTINCT CASE WHEN status IN ('OK', 'WARNING', 'SKIPPED') THEN format END) = 4 AS complete FROM r GROUP BY table_name")
def complete_tables(spark, sf_dir):
    return profile.complete_tables(results(spark, sf_dir), FORMATS)


@query(f"WITH {_RESULTS} SELECT format, (CASE WHEN count(*) FILTER (status IN ('FAILED', 'UNSUPPORTED')) > 0 THEN 1 WHEN count(*) FILTER (status = 'WARNING' OR n_warnings > 0) > 0 THEN 2 ELSE 0 END)::INTEGER AS exit_code FROM r GROUP BY format")
def exit_code(spark, sf_dir):
    return profile.exit_code(results(spark, sf_dir), by=["format"])


@query(f"WITH {_RESULTS} SELECT array_to_string(list_sort(list(DISTINCT table_name)), ',') AS tables, array_to_string(list_sort(list(DISTINCT format)), ',') AS formats FROM r")
def distinct_sorted(spark, sf_dir):
    return results(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("tables"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"))


@query(f"WITH {_RESULTS} SELECT table_name, array_to_string(list(format || '=' || status ORDER BY format), ',') AS results FROM r GROUP BY table_name")
def results_by_table(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("format", "status")))
    return results(spark, sf_dir).groupBy("table_name").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["format"], p["status"])), ",").alias("results"))


@query(f"""WITH {_RESULTS} SELECT format, count(*) FILTER (n_warnings = 0) AS clean_true, count(*) FILTER (n_warnings > 0 AND status <> 'SKIPPED') AS clean_false, count(*) FILTER (n_warnings > 0 AND status = 'SKIPPED') AS clean_unknown FROM r GROUP BY format""")
def tri_state_rollup(spark, sf_dir):
    flag = F.when(F.col("n_warnings") == 0, True).when(F.col("status") != "SKIPPED", False)
    return results(spark, sf_dir).withColumn("clean", flag).groupBy("format").agg(*profile.tri_state("clean"))


@query("""SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS has_entry FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey""")
def report_lookup(spark, sf_dir):
    report = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return compare.with_report(table(spark, sf_dir, "orders"), report, "o_custkey").select("o_orderkey", "c_name", "has_entry")


@query("""SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""")
def last_entry_wins(spark, sf_dir):
    return compare.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query(f"WITH {_PERTURBED} SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.o_orderkey = o.o_orderkey AND p.o_custkey IS NOT DISTINCT FROM o.o_custkey AND p.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus AND p.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority)")
def incremental_convert(spark, sf_dir):
    return compare.to_convert(table(spark, sf_dir, "orders"), perturbed_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query(f"WITH {_PERTURBED} SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM p WHERE p.o_orderkey = o.o_orderkey AND p.o_custkey IS NOT DISTINCT FROM o.o_custkey AND p.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus AND p.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority)")
def incremental_reuse(spark, sf_dir):
    return compare.to_reuse(table(spark, sf_dir, "orders"), perturbed_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey")


_DIFF = f"""WITH {_PERTURBED}, j AS (SELECT coalesce(o.o_orderkey, p.o_orderkey) AS record, o.o_orderkey AS ok, p.o_orderkey AS pk, o.o_orderstatus AS s1, p.o_orderstatus AS s2, o.o_orderpriority AS p1, p.o_orderpriority AS p2
  FROM orders o FULL JOIN p ON o.o_orderkey = p.o_orderkey),
  d AS (SELECT record, 'extra' AS kind, '<record>' AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual FROM j WHERE ok IS NULL UNION ALL SELECT record, 'missing', '<record>', NULL, NULL FROM j WHERE pk IS NULL
  UNION ALL SELECT record, 'field', 'o_orderstatus', s1, s2 FROM j WHERE ok IS NOT NULL AND pk IS NOT NULL AND s1 IS DISTINCT FROM s2
  UNION ALL SELECT record, 'field', 'o_orderpriority', p1, p2 FROM j WHERE ok IS NOT NULL AND pk IS NOT NULL AND p1 IS DISTINCT FROM p2)
  SELECT * FROM d"""


@query(_DIFF)
def positional_diff_all(spark, sf_dir):
    return compare.positional_diff(table(spark, sf_dir, "orders"), perturbed_orders(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(_DIFF + " ORDER BY record, field LIMIT 20")
def positional_diff(spark, sf_dir):
    return compare.positional_diff(table(spark, sf_dir, "orders"), perturbed_orders(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_orderpriority"], 20)


@query("""WITH e(ordinal, name) AS (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'status'), (4, 'o_totalprice'), (5, 'o_orderdate'), (6, 'o_orderpriority'))
  SELECT e.ordinal::INTEGER AS ordinal, e.name AS expected, x.name AS actual, e.name = x.name AS same FROM e JOIN (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus'), (4, 'o_totalprice'), (5, 'o_orderdate'), (6, 'o_orderpriority')) x(ordinal, name) ON e.ordinal = x.ordinal""")
def schema_pairing(spark, sf_dir):
    expected = ("o_orderkey", "o_custkey", "status", "o_totalprice", "o_orderdate", "o_orderpriority")

    def listed(names, column):
        return spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("p", column)).select((F.col("p") + 1).alias("ordinal"), column)

    return listed(expected, "expected").join(listed(table(spark, sf_dir, "orders").columns, "actual"), "ordinal").withColumn("same", F.col("expected") == F.col("actual"))


@query("SELECT n_nationkey AS key, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_results(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return policies.complete_union([a, b])


@query(f"WITH {_RESULTS} SELECT table_name, format, row_number() OVER (ORDER BY lower(table_name), CASE format WHEN 'csv' THEN 1 WHEN 'xlsx' THEN 2 ELSE 3 END, format)::INTEGER AS place FROM r")
def report_sort(spark, sf_dir):
    from pyspark.sql import Window

    return results(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(*profile.report_order(["csv", "xlsx"]), "format"))).select("table_name", "format", "place")


@query(f"WITH {_RESULTS} SELECT table_name, array_to_string(list_filter(['jsonl', 'csv', 'json', 'xlsx'], lambda f: NOT list_contains(list(format), f)), ',') AS lacking FROM r GROUP BY table_name")
def lacking_formats(spark, sf_dir):
    return results(spark, sf_dir).groupBy("table_name").agg(F.array_join(F.array_except(F.array(*map(F.lit, FORMATS)), F.collect_set("format")), ",").alias("lacking"))


@query(f"WITH {_RESULTS} SELECT format, array_to_string(list(table_name ORDER BY table_name)[1:5], ',') AS shown FROM r WHERE status = 'FAILED' GROUP BY format")
def shown_errors(spark, sf_dir):
    failed = results(spark, sf_dir).where(F.col("status") == "FAILED").groupBy("format")
    return failed.agg(F.array_join(F.slice(F.array_sort(F.collect_list("table_name")), 1, 5), ",").alias("shown"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 160 THEN left(text, 157) || '...' ELSE text END AS text_preview, length(text)::INTEGER AS text_length, sha256(text) AS text_sha256 FROM conversations")
def value_preview(spark, sf_dir):
    return compare.diagnostic(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "text_preview", "text_length", "text_sha256")


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN 'N'::BLOB || unhex(repeat('0', 16)) ELSE 'S'::BLOB || unhex(printf('%016X', strlen(text))) || encode(text) END) AS digest FROM documents")
def row_hash(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(scalars.value_payload(text, "string"), 256).alias("digest"))


@query("SELECT lang, count(*) AS rows, sha256(string_agg(text, '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY lang")
def ordered_table_hash(spark, sf_dir):
    return hashing.ordered_hash(table(spark, sf_dir, "documents"), "lang", "doc_id", "text")


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus = 'F' AS deleted, '["' || o_orderkey || '","' || o_orderstatus || '",' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || ']' || chr(10) AS line FROM orders)
  SELECT deleted::VARCHAR AS deleted, count(*) AS rows, sha256(string_agg(line, '' ORDER BY o_orderkey)) AS sha256 FROM l GROUP BY deleted""")
def canonical_checksum(spark, sf_dir):
    rows = marked_orders(spark, sf_dir)
    values = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))]
    lined = rows.select("o_orderkey", F.col("_deleted").cast("string").alias("deleted"), hashing.canonical_line(values).alias("line"))
    return hashing.ordered_hash(lined, "deleted", "o_orderkey", "line")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def reserved_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumns({"_ordinal": F.col("c_custkey"), "_deleted": F.lit(False), "_raw_record": F.lit(None).cast("binary")})
    kept = [c for c in rows.columns if c not in policies.RESERVED]
    return rows.select(*[c for c in kept if c in ("c_custkey", "c_name", "c_acctbal")])


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'index_metadata,record_bytes' WHEN n_nationkey % 3 = 1 THEN 'deleted_record_positions' ELSE 'inspect_offsets' END AS causes FROM nation""")
def probable_causes(spark, sf_dir):
    kind = F.col("n_nationkey") % 3
    areas = F.when(kind == 0, F.array(F.lit("header.structural_index_flag"), F.lit("record_data[record=1,offset=0]"))).when(kind == 1, F.array(F.lit("record_data[record=2,offset=5]"))).otherwise(F.array(F.lit("header.version")))
    found = compare.probable_causes(areas, F.when(kind == 1, 4).otherwise(0))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(found, ",").alias("causes"))


@query("""SELECT n_nationkey, 'a=true,b=' || (n_nationkey % 2 = 0)::VARCHAR || ',c=false' AS matches FROM nation""")
def memo_hash_matches(spark, sf_dir):
    text = F.col("n_nationkey").cast("string")
    rows = table(spark, sf_dir, "nation").withColumns({
        "left": F.create_map(F.lit("a"), text, F.lit("b"), text, F.lit("c"), text),
        "right": F.create_map(F.lit("a"), text, F.lit("b"), F.when(F.col("n_nationkey") % 2 == 0, text).otherwise(F.lit("other"))),
    })
    pairs = F.array_sort(F.map_entries("matches"))
    return compare.hash_matches(rows, "left", "right").select("n_nationkey", F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"].cast("string"))), ",").alias("matches"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem""")
def finite_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", scalars.finite(F.col("l_quantity"), "l_quantity").alias("l_quantity"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN encode(n_name) WHEN 1 THEN NULL ELSE ''::BLOB END AS bytes FROM nation""")
def strict_base64(spark, sf_dir):
    kind = F.col("n_nationkey") % 3
    text = F.when(kind == 0, scalars.base64_text(F.encode("n_name", "UTF-8"))).when(kind == 1, F.lit("!!")).otherwise(F.lit(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.strict_base64(text).alias("bytes"))


@query("""WITH d AS (SELECT n_name, lower(n_name) || '.dbf' AS data, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '.FPT' END AS memo FROM nation) SELECT n_name, data, memo, memo IS NOT NULL AS memo_present FROM d""")
def companion_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    data = nation.select("n_name", F.concat(F.lower("n_name"), F.lit(".dbf")).alias("data"))
    memos = nation.where(F.col("n_nationkey") % 2 == 0).select(F.concat(F.upper("n_name"), F.lit(".FPT")).alias("memo"))
    stem = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    joined = data.withColumn("stem", stem("data")).join(memos.withColumn("stem", stem("memo")), "stem", "left")
    return joined.select("n_name", "data", "memo", F.col("memo").isNotNull().alias("memo_present"))


def as_jsonl(spark: SparkSession, df: DataFrame, order: str, name: str) -> str:
    """Path of a JSONL file of df's rows in order."""
    path = f"{files.workspace(spark, name)}/{name}.jsonl"
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"), F.col(order).alias("_o"))
    files.write_single(lines, "line", ["_o"], path, empty=b"")
    return path


def read_back(spark: SparkSession, path: str, input_format: str, schema: str) -> DataFrame:
    return records.read_records(spark, path, input_format).select(F.from_json("record", schema).alias("r")).select("r.*")


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_SUPPLIER_TYPES = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal::DECIMAL(15, 2)::DOUBLE AS c_acctbal, c_mktsegment, c_custkey % 9 = 0 AS _deleted FROM customer")
def dbf_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("_deleted", F.col("c_custkey") % 9 == 0)
    rows = rows.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    fields = [("CUSTKEY", "I", 4, 0, 0), ("NAME", "C", 40, 0, 0), ("NATION", "I", 4, 0, 0), ("ACCTBAL", "N", 12, 2, 0), ("SEGMENT", "C", 20, 0, 0)]
    named = rows.select(F.col("c_custkey").alias("CUSTKEY"), F.col("c_name").alias("NAME"), F.col("c_nationkey").alias("NATION"), F.col("c_acctbal").alias("ACCTBAL"), F.col("c_mktsegment").alias("SEGMENT"), "_deleted")
    path = dbf_sink.new_table(named, fields, f"{files.workspace(spark, 'dbf')}/customer.dbf", order="CUSTKEY")
    back = dbf_source.read_table(spark, path)
    return back.select(F.col("CUSTKEY").cast("long").alias("c_custkey"), F.col("NAME").alias("c_name"), F.col("NATION").alias("c_nationkey"), F.col("ACCTBAL").cast("double").alias("c_acctbal"), F.col("SEGMENT").alias("c_mktsegment"), "_deleted")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN text END AS text FROM conversations")
def memo_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("CONV"), F.col("turn").alias("TURN"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("TEXT"))
    fields = [("CONV", "N", 12, 0, 0), ("TURN", "N", 6, 0, 0), ("TEXT", "M", 4, 0, 0)]
    ordered = rows.withColumn("_o", F.col("CONV") * 1000 + F.col("TURN"))
    path = dbf_sink.new_table(ordered, fields, f"{files.workspace(spark, 'memo')}/talk.dbf", order="_o", language_driver=0x03)
    back = dbf_source.read_table(spark, path, path[:-4] + ".fpt")
    return back.select(F.col("CONV").cast("long").alias("conv_id"), F.col("TURN").cast("long").alias("turn"), F.col("TEXT").alias("text"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_to_json(spark, sf_dir):
    path = as_jsonl(spark, table(spark, sf_dir, "documents"), "doc_id", "docs")
    records.jsonl_to_json(spark, path, path[:-1])
    return read_back(spark, path[:-1], "json", "doc_id long, text string, lang string, source string, n_chars long")


@query("SELECT doc_id, text, lang, source, n_chars::VARCHAR AS n_chars FROM documents")
def jsonl_to_csv(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = as_jsonl(spark, docs, "doc_id", "docs")
    kinds = {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"}
    records.jsonl_to_csv(spark, path, path[:-5] + "csv", columns=list(kinds), schema_types=kinds)
    return spark.read.csv(path[:-5] + "csv", header=True, multiLine=True, escape='"', schema="doc_id long, text string, lang string, source string, n_chars string")


@query(_SUPPLIER)
def jsonl_roundtrip(spark, sf_dir):
    return read_back(spark, as_jsonl(spark, table(spark, sf_dir, "supplier"), "s_suppkey", "supplier"), "jsonl", _SUPPLIER_TYPES)


@query(_SUPPLIER)
def csv_roundtrip(spark, sf_dir):
    path = as_jsonl(spark, table(spark, sf_dir, "supplier"), "s_suppkey", "supplier")
    records.jsonl_to_csv(spark, path, path[:-5] + "csv")
    return read_back(spark, path[:-5] + "csv", "csv", _SUPPLIER_TYPES)


@query(_SUPPLIER)
def json_roundtrip(spark, sf_dir):
    path = as_jsonl(spark, table(spark, sf_dir, "supplier"), "s_suppkey", "supplier")
    records.jsonl_to_json(spark, path, path[:-1])
    return read_back(spark, path[:-1], "json", _SUPPLIER_TYPES)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def xlsx_roundtrip(spark, sf_dir):
    path = as_jsonl(spark, table(spark, sf_dir, "documents"), "doc_id", "docs")
    records.jsonl_to_xlsx(spark, path, path[:-5] + "xlsx", max_rows_per_sheet=400)
    return read_back(spark, path[:-5] + "xlsx", "xlsx", "doc_id long, text string, lang string, source string, n_chars long")


@query("""SELECT * FROM (VALUES (0, 'ą', false), (1, 'ü', true), (2, 'plain', false), (3, 'ł', false), (4, 'ó', true)) t(id, text, fell_back)""")
def decode_fallback(spark, sf_dir):
    import pyarrow as pa

    from strataline.functions import codepages

    cases = spark.sql("SELECT * FROM VALUES (0, X'B9', 'cp1250'), (1, X'81', 'cp1250'), (2, X'706C61696E', 'ascii'), (3, X'B3', 'mazovia'), (4, X'F3', 'ascii') AS t(id, data, enc)")

    def run(batches):
        for b in batches:
            got = [codepages.decode(d, e) for d, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got])], names=["id", "text", "fell_back"])

    return cases.mapInArrow(run, "id int, text string, fell_back boolean")


@query("SELECT p_partkey, lpad(p_retailprice::DECIMAL(10, 2)::VARCHAR, 10, ' ') AS text FROM part")
def numeric_text(spark, sf_dir):
    import pyarrow as pa

    from strataline.functions import numbers

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([numbers.rendered(v, 10, 2).decode() for v in b.column(1).to_pylist()])], names=["p_partkey", "text"])

    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(10,2)").alias("v")).mapInArrow(run, "p_partkey long, text string")
