"""Long cell texts as numbered parts, and their reassembly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import scalars

LIMIT = 32_767
MARKER = "[[OVERFLOW:{}]]"


def parts(df: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(key, part, parts, text) of texts over limit UTF-16 units, parts numbered from 1.

    Texts of the basic plane are cut in the JVM; those with surrogate pairs in Arrow batches, so that no pair is parted.
    """
    units = scalars.utf16_length(F.col(text))
    long = df.where(units > limit).select(F.col(key), F.col(text).alias("whole"), (units == F.length(text)).alias("plain"))
    plain = long.where("plain").withColumn("parts", F.ceil(F.length("whole") / limit).cast("int"))
    cut = plain.select(key, "parts", "whole", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    cut = cut.select(key, "part", "parts", F.substr("whole", (F.col("part") - 1) * limit + 1, F.lit(limit)).alias("text"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, n, len(pieces), t) for k, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for pieces in [utf16_parts(value, limit)] for n, t in enumerate(pieces, 1)]
            if found:
                keys = pa.array([f[0].as_py() for f in found], batch.column(0).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.string())], names=[key, "part", "parts", "text"])

    return cut.unionByName(long.where("NOT plain").select(key, "whole").mapInArrow(others, cut.schema))


def utf16_parts(text: str, limit: int = LIMIT) -> list[str]:
    """A text cut into parts of at most limit UTF-16 units, no surrogate pair parted."""
    out, start, used = [], 0, 0
    for at, c in enumerate(text):
        width = 2 if ord(c) > 0xFFFF else 1
        if used + width > limit:
            out.append(text[start:at])
            start, used = at, 0
        used += width
    return [*out, text[start:]]


def reassembled(df: DataFrame, key: str) -> DataFrame:
    """(key, text, complete): parts joined in order; complete if all are there once."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    grouped = df.groupBy(key).agg(ordered.alias("p"), F.max("parts").alias("parts"), F.count_distinct("part").alias("n"), F.count("*").alias("rows"))
    return grouped.select(key, F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), ((F.col("n") == F.col("parts")) & (F.col("rows") == F.col("parts"))).alias("complete"))
