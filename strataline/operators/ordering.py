"""Row numbers without one-task windows: blocks of a numeric order key are counted, summed before, and numbered apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def dense_index(df: DataFrame, order: str, name: str, start: int = 0, block: int = BLOCK) -> DataFrame:
    """df with name: the row's place by an integral key without ties, from start.

    Ordinals of a scan are dense, so blocks are even; only the table of block counts (rows / block) is summed in order.
    """
    keyed = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = keyed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return keyed.join(before, "_block").withColumn(name, (F.col("_before") + inside - 1 + start).cast("long")).drop("_block", "_before")


def sheet_place(index: Column, rows_per_sheet: int) -> tuple[Column, Column]:
    """Sheet number (from 1) and row in the sheet (from 2, under its header) of a record's index (from 0)."""
    data = rows_per_sheet - 1
    return (F.floor(index / data) + 1).cast("int"), (F.pmod(index, F.lit(data)) + 2).cast("int")
