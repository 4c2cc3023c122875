"""What the operators of this subpackage share: tables, the shared folder, staging, worker caches."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII separators of the word rule: space and \x09-\x0D.
SEPARATORS = " \t\n\x0b\f\r"
#: The same as a regular-expression class.
SEPARATOR_CLASS = r"[ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a local master has none."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; a cluster needs a folder that all its machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strataline-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/strataline/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_bucket(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def worker_cache(key: str, make: Callable[[], object]) -> object:
    """An object kept for the life of this Python process (worker processes are reused between tasks)."""
    store = sys.__dict__.setdefault("_strataline_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def worker_forget(key: str) -> None:
    """Drops an object of worker_cache."""
    sys.__dict__.get("_strataline_cache", {}).pop(key, None)


def give_back() -> None:
    """Returns to the system what this worker process no longer uses, vocabularies among it."""
    for key in [k for k in sys.__dict__.get("_strataline_cache", {}) if k.startswith("vocabulary ")]:
        worker_forget(key)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; after each task the worker gives its memory back: it stays, idle, beside all later stages."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def values_of(column: pa.Array, rows: int = 256) -> Iterator:
    """A column's values, so many rows at a time: of a batch of long texts there is never a whole second copy."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def bit_set(keys: DataFrame, bits: int) -> bytes:
    """A bit of 2**bits for the leading bits of each 64-bit key, gathered in two levels of streaming tasks; packed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)])], names=["bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for blob in batch.column(0):
                total |= np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], names=["bits"])

    found = keys.mapInArrow(mark, "bits binary").repartition(8).mapInArrow(join, "bits binary").repartition(1).mapInArrow(join, "bits binary").collect()
    return zlib.decompress(bytes(found[0][0]))
