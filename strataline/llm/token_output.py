"""Token-id output: packed id matrices with cumulative segment lengths and position resets.

Texts become ids once. In each partition, blocks of `BLOCK` pieces are packed by best-fit-decreasing with a
segment-tree capacity search; sequences with at most `WASTE` free tokens are final where they are, and only the
pieces of the others are shuffled, packed together by the exact plan over their histogram. A sequence is a row:
`ids` (capacity little-endian unsigned ids of `id_bytes` bytes, the rest filled with 0xFF bytes), `cu_seqlens` (0 and each segment's end) and
`positions` resets (each segment's start is where position ids return to zero). Overlong documents are cut without
loss; segments name document, piece and start, so the texts' ids can be put together again.

Defined cases: a null text is an empty document (the end id alone); repeated ids are packed row by row; an empty table
gives an empty output; extra columns are ignored; very long texts are cut into pieces of the capacity; ids take two
bytes, or four where the vocabulary has ids of 65,535 and more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm import binpack, tokens
from strataline.llm.common import staged

BLOCK = 2048
WASTE = 0
PAD = b"\xff"
MATRIX = "sequence_id long, id_bytes int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
_MATRIX = pa.schema([("sequence_id", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))])
#: Where a loose piece was met, for its rank: the task's part and the piece's number in it.
_PLACED = _MATRIX.append(pa.field("_part", pa.int32())).append(pa.field("_row", pa.int64()))


def row(sequence_id: int | None, segments: list[tuple[int | None, int, int, bytes]], capacity: int, width: int) -> dict:
    """A packed row from (doc_id, piece, start, ids) segments in order, width bytes an id."""
    ends = np.cumsum([0, *(len(s[3]) // width for s in segments)]).tolist()
    body = b"".join(s[3] for s in segments)
    ids = body + PAD * (capacity * width - len(body))
    return {"sequence_id": sequence_id, "id_bytes": width, "ids": ids, "cu_seqlens": ends, "resets": ends[:-1], "doc_ids": [s[0] for s in segments], "pieces": [s[1] for s in segments], "starts": [s[2] for s in segments]}


def packed_blocks(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Written rows: full sequences, and each loose piece as a row of its own without sequence_id but with _part and _row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, width = TaskContext.get().partitionId(), [], tokens.id_bytes(path)
        number, loose = part << 40, 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, loose
            out = []
            for members in binpack.pack_block([len(b[3]) // width for b in block], capacity):
                segments = [block[i] for i in members]
                if sum(len(s[3]) // width for s in segments) >= capacity - WASTE:
                    out.append(row(number, segments, capacity, width))
                    number += 1
                else:
                    for s in segments:
                        out.append(row(None, [s], len(s[3]) // width, width) | {"_part": part, "_row": loose})
                        loose += 1
            for at in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[at : at + 512], schema=_PLACED)

        for batch in batches:
            for doc_id, piece, start, ids in tokens.pieces_of(batch, path, capacity):
                block.append((doc_id, piece, start, ids.astype(f"<u{width}").tobytes()))
                if len(block) == BLOCK:
                    yield from packed()
                    block = []
        if block:
            yield from packed()

    return staged(docs.mapInArrow(run, f"{MATRIX}, _part int, _row long"), "token-blocks")


def assembled(placed: DataFrame, capacity: int) -> DataFrame:
    """Matrix rows from placed single pieces: sorted by sequence and offset, a sequence at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, segments, out, width = None, [], [], 2
        for batch in batches:
            for r in batch.to_pylist():
                if r["sequence_id"] != current and segments:
                    out.append(row(current, segments, capacity, width))
                    segments = []
                current, width = r["sequence_id"], r["id_bytes"]
                segments.append((r["doc_ids"][0], r["pieces"][0], r["starts"][0], r["ids"]))
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=_MATRIX)
                out = []
        if segments:
            out.append(row(current, segments, capacity, width))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_MATRIX)

    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, MATRIX)


def write_matrices(docs: DataFrame, capacity: int = tokens.CAPACITY, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed rows of all documents, written to the shared folder."""
    blocks = packed_blocks(tokens.pairs(docs, key, text), path or tokens.tokenizer_path(), capacity)
    loose = blocks.where(F.col("sequence_id").isNull()).drop("sequence_id").withColumn("length", F.element_at("cu_seqlens", -1).cast("long"))
    lengths = binpack.histogram(loose)
    bins, runs = binpack.plan(lengths, capacity)
    rest = staged(assembled(binpack.place(loose, runs, first_id=-bins), capacity), "token-rest") if lengths else None
    full = blocks.where(F.col("sequence_id").isNotNull()).drop("_part", "_row")
    return full if rest is None else full.unionByName(rest)


def read_segments(matrices: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every segment, from the matrices alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, ends = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4"), r["cu_seqlens"]
                if r["resets"] != ends[:-1]:
                    raise ValueError(f"sequence {r['sequence_id']}: position resets differ from segment starts")
                for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    out.append((r["doc_ids"][k], r["pieces"][k], r["starts"][k], b - a, zlib.crc32(ids[a:b].tobytes()), r["sequence_id"], a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return matrices.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
