"""Row and column policies of an export: deleted rows, memo values, projection, reserved columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import scalars

DELETED = "_deleted"
RESERVED = ("_ordinal", "_deleted", "_raw_record", "_raw_text_fields", "_binary_memo_fields")


def apply_deleted(df: DataFrame, policy: str) -> tuple[DataFrame, DataFrame | None]:
    """The data rows and, for "separate", the deleted rows.

    skip: active rows; include: all rows with the flag; separate: two branches over one scan.
    """
    if policy == "skip":
        return df.where(~F.col(DELETED)), None
    if policy == "include":
        return df, None
    if policy == "separate":
        return df.where(~F.col(DELETED)), df.where(F.col(DELETED))
    raise ValueError(f"unknown policy for deleted rows: {policy}")


def apply_memo(df: DataFrame, memo_columns: Sequence[str], policy: str) -> DataFrame:
    """inline keeps memo values, skip and null make them null."""
    if policy == "inline":
        return df
    if policy not in ("skip", "null"):
        raise ValueError(f"unknown memo policy: {policy}")
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in memo_columns})


def default_memo(output_format: str, chosen: str | None) -> str:
    """The chosen policy, else csv skips memo and the others keep it."""
    return chosen or ("skip" if output_format == "csv" else "inline")


def project(df: DataFrame, fields: Sequence[str], strip: Sequence[str] = (), keep_deleted: bool = False) -> DataFrame:
    """Fields in order, the stripped ones without trailing white space, then the flag if asked for."""
    columns = [scalars.strip_trailing(F.col(f)).alias(f) if f in strip else F.col(f) for f in fields]
    return df.select(*columns, *([F.col(DELETED)] if keep_deleted else []))


def null_by_bitmap(df: DataFrame, bitmap: str, nullable: Sequence[str]) -> DataFrame:
    """Columns set to null where their bit (their place among the nullable ones, lowest first) is set."""
    kind = dict(df.dtypes)[bitmap]
    test = scalars.bytes_bit_is_set if kind == "binary" else scalars.bit_is_set
    return df.withColumns({c: F.when(~F.coalesce(test(F.col(bitmap), k), F.lit(False)), F.col(c)) for k, c in enumerate(nullable)})


def merge_columns(configured: Sequence[str], discovered: Sequence[str]) -> list[str]:
    """Configured columns, then discovered ones not yet named."""
    return list(dict.fromkeys([*configured, *discovered]))


def complete_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; a column that a part lacks is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
