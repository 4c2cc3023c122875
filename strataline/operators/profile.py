"""Column profiles, JSON column inference and report roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import scalars

USABLE = ("OK", "WARNING", "SKIPPED")
FAILING = ("FAILED", "UNSUPPORTED")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, rows, nulls, empties) in one pass; empties counts "" only, in string columns."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    stats = [F.count("*").alias("rows")]
    for k, c in enumerate(columns):
        stats.append(F.count_if(F.col(c).isNull()).alias(f"n{k}"))
        stats.append((F.count_if(F.col(c) == "") if kinds[c] == "string" else F.lit(0).cast("long")).alias(f"e{k}"))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("rows"), F.col(f"n{k}").alias("nulls"), F.col(f"e{k}").alias("empties")) for k, c in enumerate(columns)))
    return df.agg(*stats).select(F.inline(rows))


def json_columns(df: DataFrame, text: str, line: str) -> DataFrame:
    """(key, kinds, first_line) of every key of JSON objects: its kinds sorted, and the first line that has it."""
    members = "cast(try_parse_json(_text) as map<string, variant>)"
    typed = f"transform(map_entries({members}), m -> struct(m.key as key, schema_of_variant(m.value) as type))"
    rows = df.select(F.col(line).alias("line"), F.col(text).alias("_text")).select("line", F.inline(F.expr(typed)))
    raw = rows.select("line", "key", scalars.variant_kind(F.col("type")).alias("kind"))
    return raw.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min("line").alias("first_line"))


def is_json_object(text):
    """Whether a line is a JSON object; null and blank lines aren't."""
    parsed = F.try_parse_json(text)
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def line_counts(df: DataFrame, text: str) -> DataFrame:
    """(records, skipped_invalid) of JSONL lines; blank lines are neither."""
    lines = df.where(F.length(F.trim(F.col(text))) > 0)
    good = is_json_object(F.col(text))
    return lines.agg(F.count_if(good).alias("records"), F.count_if(~good).alias("skipped_invalid"))


def status_rollup(results: DataFrame) -> DataFrame:
    """Counts of each status by format."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in (*USABLE, *FAILING)]
    return results.groupBy("format").agg(F.count("*").alias("results"), *counts)


def complete_tables(results: DataFrame, formats: Sequence[str]) -> DataFrame:
    """(table_name, complete): every requested format is there and usable."""
    good = F.collect_set(F.when(F.col("status").isin(*USABLE), F.col("format")))
    return results.groupBy("table_name").agg((F.size(F.array_except(F.array(*map(F.lit, formats)), good)) == 0).alias("complete"))


def exit_code(results: DataFrame, warnings: str = "n_warnings", by: Sequence[str] = ()) -> DataFrame:
    """1 with a failure, else 2 with a warning, else 0; of all results, or of each group's."""
    failed = F.count_if(F.col("status").isin(*FAILING)) > 0
    warned = F.count_if((F.col("status") == "WARNING") | (F.col(warnings) > 0)) > 0
    return results.groupBy(*by).agg(F.when(failed, 1).when(warned, 2).otherwise(0).alias("exit_code"))


def tri_state(flag: str) -> list:
    """Counts of a flag's true, false and unknown."""
    c = F.col(flag)
    return [F.count_if(c).alias(f"{flag}_true"), F.count_if(~c).alias(f"{flag}_false"), F.count_if(c.isNull()).alias(f"{flag}_unknown")]


def report_order(formats: Sequence[str]):
    """Sort keys of report rows: table, then the place of the format as requested, others last."""
    place = F.array_position(F.array(*map(F.lit, formats)), F.col("format"))
    return F.lower("table_name"), F.when(place > 0, place).otherwise(len(formats) + 1).cast("int")
