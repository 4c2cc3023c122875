"""Ordered hashes of tables, and hashes of files.

SHA-256 states don't merge, so an ordered hash is one pass in order. Payloads are made in parallel; the fold streams
Arrow batches of one sorted partition a group, with memory of a batch. The block form hashes even blocks of rows in
parallel and then the blocks' digests: another value, for tables too large for one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.sources import files


def ordered_hash(df: DataFrame, group: str, order: str, payload: str) -> DataFrame:
    """(group, rows, sha256): payload bytes of each group's rows, hashed in order."""
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), F.col(payload).cast("binary").alias("p"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, state, done = None, 0, None, []
        for batch in batches:
            for g, p in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if state is None or g != current:
                    if state is not None:
                        done.append((current, seen, state.hexdigest()))
                    current, seen, state = g, 0, hashlib.sha256()
                state.update(p.as_buffer() or b"")
                seen += 1
        if state is not None:
            done.append((current, seen, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.string()) for i, c in enumerate(zip(*done, strict=True))], names=["g", "rows", "sha256"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g").sortWithinPartitions("g", "o").mapInArrow(fold, "g string, rows long, sha256 string").withColumnRenamed("g", group)


def block_hash(df: DataFrame, order: str, payload: str, block: int = 1 << 16) -> DataFrame:
    """(sha256_blocks): digest of the digests of even blocks of an integral order key."""
    blocks = ordered_hash(df.withColumn("_b", F.floor(F.col(order) / block)), "_b", order, payload)
    digests = blocks.select(F.lit("all").alias("a"), F.col("_b").cast("long").alias("b"), F.encode("sha256", "UTF-8").alias("p"))
    return ordered_hash(digests, "a", "b", "p").select(F.col("sha256").alias("sha256_blocks"))


def canonical_line(values: Sequence[str]):
    """JSON line of canonical text values, in order."""
    return F.concat(F.to_json(F.array(*values), {"ignoreNullFields": "false"}), F.lit("\n"))


def hashes_of(spark, paths: Sequence[str], limit: int = 4096) -> DataFrame:
    """(path, size_bytes, sha256) of files, each streamed by a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, files.size(p), files.sha256(p)) for p in batch.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["path", "size_bytes", "sha256"])

    rows = spark.createDataFrame([(str(p),) for p in paths], "path string").repartition(max(1, min(len(paths), limit)))
    return rows.mapInArrow(run, "path string, size_bytes long, sha256 string")
