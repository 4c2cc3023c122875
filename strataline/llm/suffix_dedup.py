"""Removal of repeated byte strings with sampled suffixes, sorted deep-shallow.

A byte goes if a `length`-byte string that covers it also starts anywhere else, in any document. Of the suffixes only
anchors are handled: in each string of `length` bytes the leftmost smallest hash of its `GRAM`-byte substrings. Equal
strings have their anchor at the same place, so every repeat is found among anchors of equal substrings, with about one
suffix in seventy-five. An anchor stands for the strings (starts) that chose it; its context is the text they span.

1. Anchors are dealt by their substring's hash and sorted by their context's: contexts that occur again are repeats
   whole. Repeats within a task are told there, and one row stands for them, so a common passage makes no hot group. What differs from all others, with a representative of each other context of the substring, goes on.
2. Those contexts are fetched, and the suffixes and the reversed prefixes at their anchors are sorted deep-shallow.
   From both orders' common prefixes each string (left part, right part) gets a class; a class of two is a repeat.
3. Ranges of repeated starts meet their documents, which drop the covered bytes.

Texts are shuffled only for documents that have repeats to remove or to compare, told by a fixed-size bit set.

Defined cases: a null text has no bytes; a text under `length` bytes keeps all; repeated rows repeat each other, whatever
their ids; an empty table gives an empty result; extra columns are ignored; very long texts are anchored in segments
and never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import bit_set, staged, worker_cache
from strataline.llm.suffix_sort import deep_shallow
from strataline.llm.words import mix

LENGTH = 200
GRAM = 50
SEGMENT = 1 << 20
#: Bits of the set that tells which documents to shuffle: 4 MB whatever the corpus.
BITS = 25
#: Contexts sorted together.
TOGETHER = 30_000
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


def _tables() -> dict:
    out = {}
    for name, base in zip("ab", _BASES, strict=True):
        size = SEGMENT + LENGTH + 1
        power, inverse = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        power[0] = inverse[0] = 1
        out[name] = (mix(np.arange(256, dtype=np.uint64) + np.uint64(base & 0xFFFF)), np.multiply.accumulate(power), np.multiply.accumulate(inverse))
    return out


def _sums(data: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte values times powers, and the inverse powers."""
    values, power, inverse = worker_cache("suffix tables", _tables)[name]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=total[1:])
    return total, inverse


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of one segment: anchors' positions, first and last starts, hashes of their substrings and of their contexts."""
    starts = len(data) - length + 1
    if starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums, inverse = _sums(data, "a")
    grams = (sums[gram:] - sums[:-gram]) * inverse[: len(sums) - gram]
    window, n = length - gram + 1, len(grams)
    key = mix(grams)
    key = (key >> np.uint64(21) << np.uint64(21)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // window)
    square = np.full(blocks * window, np.uint64(2**64 - 1))
    square[:n] = key
    square = square.reshape(blocks, window)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
    place = (smallest & np.uint64((1 << 21) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:] - 1, starts - 1]
    at = place[first]
    other, other_inverse = _sums(data, "b")
    end = last + length
    context = mix((sums[end] - sums[first]) * inverse[first], (other[end] - other[first]) * other_inverse[first], (at - first).astype(np.uint64), (last - first).astype(np.uint64))
    return at, first, last, grams[at], context


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key: of a row's id and text; equal rows share it and so have equal results."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "key", "at", "first", "last", "many", "local", "deal"]

        def out(parts: list) -> pa.RecordBatch:
            gram, context, key, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
            gram, context = gram.view(np.int64), context.view(np.int64)
            order = np.lexsort((context, gram))
            gram, context, key, *rest = (c[order] for c in (gram, context, key, *rest))
            new = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])]
            sizes = np.diff(np.r_[np.flatnonzero(new), len(gram)])
            # A context met twice here is a repeat: one row stands for it among its substring's, the others are dealt by document.
            many, local = np.repeat(sizes > 1, sizes), ~new
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (gram, context, key, *rest, many, local, np.where(local, key, gram))], names=names)

        parts, held = [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, value in zip(keys, batch.column(1), strict=True):
                data = np.frombuffer(value.as_buffer() or b"", np.uint8)
                for base in range(0, max(1, len(data) - length + 1), SEGMENT):
                    at, first, last, grams, context = anchors(data[base : base + SEGMENT + length - 1], length, gram)
                    if len(at):
                        parts.append((grams, context, np.full(len(at), k, np.int64), at + base, first + base, last + base))
                        held += len(at)
                if held > 1 << 17:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return docs.select("key", "text").mapInArrow(run, "gram long, context long, key long, at long, first long, last long, many boolean, local boolean, deal long")


def _met(rows: DataFrame) -> DataFrame:
    """Written rows of anchors whose substring occurs again: kind 0, a range that is a repeat; 1, a context to compare and judge; 2, one to compare only."""

    def shown(table: pa.Table, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from table.select(["gram", "context", "key", "at", "first", "last"]).append_column("kind", pa.array(kind)).to_batches()

    def decided(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, context = table.column("gram").to_numpy(), table.column("context").to_numpy()
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, context[1:] != context[:-1]]
        starts = np.flatnonzero(new)
        again = (np.diff(np.r_[starts, len(gram)]) > 1) | np.logical_or.reduceat(table.column("many").to_numpy(), starts)
        run = np.cumsum(new_gram[starts]) - 1
        several = np.bincount(run)[run] > 1
        rows = np.repeat(again, np.diff(np.r_[starts, len(gram)]))
        single = starts[several & ~again]
        partner = starts[several & again]
        picked = np.concatenate([np.flatnonzero(rows), single, partner])
        if len(picked):
            kind = np.repeat(np.array([0, 1, 2], np.int32), [int(rows.sum()), len(single), len(partner)])
            yield from shown(table.take(pa.array(picked)), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            local = batch.column(batch.schema.get_field_index("local"))
            if alone := pc.sum(local).as_py():
                yield from shown(pa.Table.from_batches([batch.filter(local)]), np.zeros(alone, np.int32))
                batch = batch.filter(pc.invert(local))
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < 1 << 16:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield from decided(table.slice(0, cut))
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield from decided(pa.Table.from_batches(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "deal").sortWithinPartitions("local", "gram", "context")
    return staged(dealt.mapInArrow(run, "gram long, context long, key long, at long, first long, last long, kind int"), "dedup-met")


def _dealt_texts(docs: DataFrame, bits: bytes) -> DataFrame:
    """Written rows (key, doc_id, n_bytes, sha256, text): text only where the bit set has the key."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            hit = marked[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)]
            sizes, digests = [], []
            for value, known in zip(batch.column(2), hit, strict=True):
                data = value.as_buffer() or b""
                sizes.append(len(memoryview(data)))
                digests.append(None if known else hashlib.sha256(data).hexdigest())
            texts = pc.if_else(pa.array(hit), batch.column(2), pa.scalar(None, batch.column(2).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), texts], names=["key", "doc_id", "n_bytes", "sha256", "text"])

    return staged(docs.mapInArrow(run, "key long, doc_id long, n_bytes long, sha256 string, text string"), "dedup-texts")


def repeated_starts(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, length: int) -> np.ndarray:
    """For each context a row of length flags: whether the string that starts d bytes before the anchor occurs twice.

    lefts are the reversed bytes before the anchors (no more than the first start needs), rights those from the anchors on.
    """
    n = len(lefts)
    orders = [deep_shallow(x, groups) for x in (lefts, rights)]
    low, high = length - np.array([len(r) for r in rights]), np.array([len(x) for x in lefts])
    out = np.zeros((n, int(high.max()) + 1), bool)
    for d in range(int(low.min()), int(high.max()) + 1):
        valid = np.flatnonzero((low <= d) & (d <= high))
        if len(valid) < 2:
            continue
        classes = []
        for (order, prefix), depth in zip(orders, (d, length - d), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum((prefix < depth) | (prefix < 0))
            classes.append(number[valid])
        both = classes[0] * (n + 1) + classes[1]
        ranked = np.argsort(both, kind="stable")
        same = np.zeros(len(valid) + 1, bool)
        same[1:-1] = both[ranked][1:] == both[ranked][:-1]
        out[valid[ranked[same[1:] | same[:-1]]], d] = True
    return out


def _compared(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Written rows (key, first, last): ranges of repeated starts among the contexts to judge."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value, first, last in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(bytes(memoryview(value.as_buffer())[first : last + length]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=[*batch.schema.names[1:], "bytes"])

    def judged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        first, _, key, at, kind, gram, data = map(list, zip(*rows, strict=True))
        lefts = [d[: a - f][::-1] for d, a, f in zip(data, at, first, strict=True)]
        rights = [d[a - f :] for d, a, f in zip(data, at, first, strict=True)]
        flags = repeated_starts(lefts, rights, np.unique(gram, return_inverse=True)[1], length)
        keys, firsts, lasts = [], [], []
        for i in np.flatnonzero((np.array(kind) == 1) & flags.any(axis=1)).tolist():
            d = np.flatnonzero(flags[i])
            for run in np.split(d, np.flatnonzero(np.diff(d) > 1) + 1):
                keys.append(key[i])
                firsts.append(at[i] - int(run[-1]))
                lasts.append(at[i] - int(run[0]))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, firsts, lasts)], names=["key", "first", "last"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= TOGETHER and row[5] != rows[-1][5]:
                    yield from judged(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from judged(rows)

    joined = texts.where(F.col("text").isNotNull()).select("key", "text").dropDuplicates(["key"]).join(asked, "key")
    contexts = joined.select("text", "first", "last", "key", "at", "kind", "gram").mapInArrow(cut, "first long, last long, key long, at long, kind int, gram long, bytes binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(parts, "gram").sortWithinPartitions("gram")
    return staged(dealt.mapInArrow(compare, "key long, first long, last long"), "dedup-compared")


def _dropped(texts: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of the documents with a text."""
    # Repeated rows share a key and give the same ranges, which are gathered once.
    by_key = ranges.repartition("key").distinct().groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for value, firsts, lasts in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                data = np.frombuffer(value.as_buffer() or b"", np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, np.array(firsts or [], np.int64), 1)
                np.add.at(edge, np.array(lasts or [], np.int64) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0)
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.where(F.col("text").isNotNull()).join(by_key, "key", "left").select("doc_id", "n_bytes", "text", "firsts", "lasts")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _ranges(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The dealt texts and all ranges (key, first, last) of repeated starts."""
    met = _met(_anchor_rows(docs, length, gram))
    texts = _dealt_texts(docs, bit_set(met.select("key"), BITS))
    compared = _compared(texts, met.where("kind > 0").select("key", "first", "last", "at", "kind", "gram"), length)
    return texts, met.where("kind = 0").select("key", "first", "last").unionByName(compared)


def removed_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    texts, ranges = _ranges(_keyed(df, key, text), length, gram)
    cut = _dropped(texts, ranges, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    whole = texts.where(F.col("text").isNull()).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    return cut.unionByName(whole)


def deduplicated(df: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and kept (the bytes left of each text; cutting may part a character)."""
    docs = _keyed(df, key, text)
    texts, ranges = _ranges(docs, length, gram)
    whole = docs.join(texts.where(F.col("text").isNull()).select("key").distinct(), "key").select("doc_id", F.col("text").cast("binary").alias("kept"))
    return _dropped(texts, ranges, length).select("doc_id", "kept").unionByName(whole)
