"""Comparison of record sequences, reports and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import scalars


def positional_diff(expected: DataFrame, actual: DataFrame, ordinal: str, fields: Sequence[str], limit: int | None = None) -> DataFrame:
    """(record, field, expected, actual, kind) of every difference by position, records on one side as kind missing or extra.

    Rows whose hashes agree go before fields are compared. The limit is part of the report, first records first.
    """
    texts = [F.col(f).cast("string").alias(f) for f in fields]
    left = expected.select(F.col(ordinal).alias("record"), F.struct(*texts).alias("e"))
    right = actual.select(F.col(ordinal).alias("record"), F.struct(*texts).alias("a"))
    both = left.join(right, "record", "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    whole = F.when(F.col("e").isNull(), "extra").when(F.col("a").isNull(), "missing")
    changes = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").alias("expected"), F.col(f"a.{f}").alias("actual")) for f in fields))
    changed = F.filter(changes, lambda c: ~c["expected"].eqNullSafe(c["actual"]))
    alone = F.array(F.struct(F.lit("<record>").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    found = both.select("record", F.coalesce(whole, F.lit("field")).alias("kind"), F.explode(F.when(whole.isNotNull(), alone).otherwise(changed)).alias("d"))
    found = found.select("record", "kind", "d.field", "d.expected", "d.actual")
    return found.orderBy("record", "field").limit(limit) if limit else found


def sequence_diff(expected: DataFrame, actual: DataFrame, ordinal: str, fields: Sequence[str], limit: int) -> DataFrame:
    """positional_diff of two sequences up to the first record that only one has, fields in their order, the first `limit` ones."""
    found = positional_diff(expected, actual, ordinal, fields)
    end = found.where("kind <> 'field'").agg(F.min("record").alias("_end"))
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    return found.join(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("record") <= F.col("_end"))).drop("_end").orderBy("record", place).limit(limit)


def record_diff(expected: DataFrame, actual: DataFrame, ordinal: str, record: str, limit: int | None = None) -> DataFrame:
    """(record, field, expected, actual, kind) as positional_diff, of JSON objects as text, over the keys of either side.

    Values are compared and reported as JSON text, so types count; a number's notation does not, a missing key is null.
    """
    left = expected.select(F.col(ordinal).alias("record"), F.col(record).alias("e"))
    right = actual.select(F.col(ordinal).alias("record"), F.col(record).alias("a"))
    both = left.join(right, "record", "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    whole = F.when(F.col("e").isNull(), "extra").when(F.col("a").isNull(), "missing")
    values = lambda c: F.map_filter(F.transform_values(F.parse_json(c).cast("map<string,variant>"), lambda k, v: F.to_json(v)), lambda k, v: v != "null")
    both = both.select("record", whole.alias("whole"), values("e").alias("e"), values("a").alias("a"))
    keys = F.array_union(F.map_keys("e"), F.map_keys("a"))
    changes = F.transform(keys, lambda k: F.struct(k.alias("field"), F.element_at("e", k).alias("expected"), F.element_at("a", k).alias("actual")))
    changed = F.filter(changes, lambda c: ~c["expected"].eqNullSafe(c["actual"]))
    alone = F.array(F.struct(F.lit("<record>").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    found = both.select("record", F.coalesce("whole", F.lit("field")).alias("kind"), F.explode(F.when(F.col("whole").isNotNull(), alone).otherwise(changed)).alias("d"))
    found = found.select("record", "kind", "d.field", "d.expected", "d.actual")
    return found.orderBy("record", "field").limit(limit) if limit else found


def diagnostic(df: DataFrame, column: str) -> DataFrame:
    """df with a value's length, hash and preview."""
    c = F.col(column)
    return df.withColumns({f"{column}_length": F.length(c), f"{column}_sha256": F.sha2(c, 256), f"{column}_preview": scalars.preview(c)})


def same_source(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Null-safe equality of fingerprints."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def to_convert(found: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables without a manifest entry of the same fingerprint."""
    return found.join(manifest, same_source(found, manifest, keys), "left_anti")


def to_reuse(found: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables with a manifest entry of the same fingerprint."""
    return found.join(manifest, same_source(found, manifest, keys), "left_semi")


def with_report(tables: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """tables with their report entry, and whether there is one."""
    return tables.join(report.withColumn("_there", F.lit(True)), key, "left").withColumn("has_entry", F.coalesce("_there", F.lit(False))).drop("_there")


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def hash_matches(df: DataFrame, left: str, right: str) -> DataFrame:
    """Map columns of hashes compared key by key: true only where both sides agree."""
    return df.withColumn("matches", F.map_zip_with(left, right, lambda k, a, b: F.coalesce(a == b, F.lit(False))))


def probable_causes(areas, deleted_records):
    """Explanations of the areas in which files differ."""
    in_records = F.exists(areas, lambda a: a.startswith("record_data"))
    causes = F.array(
        F.when(F.array_contains(areas, "header.structural_index_flag"), "index_metadata"),
        F.when(F.array_contains(areas, "header.last_update"), "last_update"),
        F.when(F.array_contains(areas, "field_descriptors_or_header_padding"), "descriptor_or_backlink"),
        F.when(in_records & (deleted_records > 0), "deleted_record_positions").when(in_records, "record_bytes"),
    )
    found = F.array_compact(causes)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("inspect_offsets")))
