"""Best-fit-decreasing bin packing: a capacity tree, a packer for one block, and a plan for any number of items.

The plan works on the histogram of lengths alone (at most `capacity` entries however many items there are): bins of
equal history are ranges, so best-fit-decreasing over billions of items takes time and memory of the histogram's
order. Items then find their bins from their rank among those of their length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths, drawn at random, that a search for an exact filling tries at each depth beyond two pieces.
TRIES = 4


class CapacityTree:
    """Segment tree over residual capacities 0..capacity that says where open bins are."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, residual: int, bins: int) -> None:
        node = residual + self.size
        while node:
            self.counts[node] += bins
            node >>= 1

    def tightest(self, length: int) -> int:
        """The smallest residual >= length with an open bin; -1 without one."""
        counts, node = self.counts, length + self.size
        if counts[node]:
            return length
        while node > 1:
            if not node & 1 and counts[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if counts[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


class Stock:
    """Pieces by length, from which those that fill a space exactly are taken."""

    def __init__(self, pieces: list[int], lengths: list[int], capacity: int, random: np.random.Generator) -> None:
        self.lengths, self.random = lengths, random
        self.counts, self.at = np.zeros(capacity + 1, np.int64), {}
        for i in pieces:
            self.counts[lengths[i]] += 1
            self.at.setdefault(lengths[i], []).append(i)

    def take(self, length: int) -> int:
        self.counts[length] -= 1
        return self.at[length].pop()

    def filling(self, room: int, most: int) -> list[int] | None:
        """At most `most` pieces that fill room exactly, taken out; None where none are found."""
        found = self._exact(room, most)
        return None if found is None else [self.take(n) for n in found]

    def _exact(self, room: int, most: int) -> list[int] | None:
        counts = self.counts
        if counts[room]:
            return [room]
        if most < 2 or room < 2:
            return None
        have = counts[:room] > 0
        pairs = np.flatnonzero(have[1:] & have[:0:-1])
        if len(pairs) and ((a := int(pairs[-1]) + 1) * 2 != room or counts[a] > 1):
            return [a, room - a]
        if most < 3:
            return None
        own = np.flatnonzero(have)
        for a in np.sort(self.random.permutation(own)[:TRIES])[::-1].tolist():
            counts[a] -= 1
            rest = self._exact(room - a, most - 1)
            counts[a] += 1
            if rest is not None:
                return [a, *rest]
        return None


def pack_block(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions) by best fit, longest first; each residual keeps its bins in a stack."""
    tree, at, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        length = lengths[i]
        residual = tree.tightest(length)
        if residual < 0:
            bins.append([i])
            residual, home = capacity, len(bins) - 1
        else:
            home = at[residual].pop()
            tree.add(residual, -1)
            bins[home].append(i)
        at.setdefault(residual - length, []).append(home)
        tree.add(residual - length, 1)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> tuple[int, dict[int, list[tuple[int, int, int, int]]]]:
    """Number of bins, and for each length runs (first rank, first bin, items a bin, offset in the bin).

    A bin takes at most O(sqrt(capacity)) different lengths and each length opens or splits a few ranges, so the runs
    are bounded by the capacity alone.
    """
    tree, ranges, runs, bins = CapacityTree(capacity), {}, {}, 0
    for length in sorted(histogram, reverse=True):
        left, rank, out = histogram[length], 0, runs.setdefault(length, [])
        while left:
            residual = tree.tightest(length)
            if residual < 0:
                each = capacity // length
                residual, first, count = capacity, bins, -(-left // each)
                bins += count
            else:
                first, count = ranges[residual].pop()
                tree.add(residual, -count)
                each = residual // length
            whole, part = divmod(left, each)
            used = min(count, whole)
            if used:
                out.append((rank, first, each, capacity - residual))
                rank, left = rank + used * each, left - used * each
                ranges.setdefault(residual - each * length, []).append((first, used))
                tree.add(residual - each * length, used)
            if used < count and left:
                out.append((rank, first + used, part, capacity - residual))
                rank, left = rank + part, 0
                ranges.setdefault(residual - part * length, []).append((first + used, 1))
                tree.add(residual - part * length, 1)
                used += 1
            if used < count:
                ranges.setdefault(residual, []).append((first + used, count - used))
                tree.add(residual, count - used)
    return bins, runs


def histogram(pieces: DataFrame) -> dict[int, int]:
    """Pieces by length: at most capacity rows reach the driver."""
    return {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _part and _row, to be written: numbers that a later read of the written table can't change."""
    return rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})


def place(pieces: DataFrame, runs: dict[int, list[tuple[int, int, int, int]]], first_id: int = 0) -> DataFrame:
    """pieces (a written table with _part and _row) with sequence_id and offset by the plan's runs.

    A piece's rank among those of its length is its rank in its part plus the counts of the parts before: no length,
    however common, meets in one task. Part and row are columns of the table, so however its reads are split, ranks stay.
    """
    here = pieces
    counts = here.groupBy("length", "_part").count()
    before = counts.select("length", "_part", (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row"))
    ranked = here.withColumn("_local", local).join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_local") - 1).drop("_part", "_row", "_local", "_before")
    sent = pieces.sparkSession.sparkContext.broadcast({k: ([r[0] for r in v], v) for k, v in runs.items()})

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("_rank")
            ids, offsets = [], []
            for length, rank in zip(batch.column(batch.schema.get_field_index("length")).to_pylist(), batch.column(where).to_pylist(), strict=True):
                firsts, found = sent.value[length]
                rank0, first, each, offset = found[bisect_right(firsts, rank) - 1]
                ids.append(first_id + first + (rank - rank0) // each)
                offsets.append(offset + length * ((rank - rank0) % each))
            kept = [i for i in range(batch.num_columns) if i != where]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    schema = ranked.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(put, schema)
