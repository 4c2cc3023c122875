"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Features of a text, hashed to 2**BITS weights: words and word pairs, the same over word shapes (first and last
characters' classes, so that unseen words still count), the share of repeated three-word windows, and the length in
words by powers of two. Counts are divided by the number of words, so a score is a sparse dot product whatever the
length. Labels, language, source and id are never features.

Training takes at most `TRAIN_ROWS` labelled rows, those with the smallest hash of their id, outside the held-out
fifth; that bound is this module's only sample. One task trains (the update is sequential and the rows are bounded);
scoring covers every row. The weights (2**BITS floats, 1 MB at 18 bits) are broadcast, a bound that no data changes.

Defined cases: a null or empty text has only the length feature, and gets a score; a very long text is one sparse
vector of all its words; rows without a label or with a null one don't train; a row without an id is held out; with no
training row at all every score is 0.5; repeated ids are scored row by row, and train within the same bound; an empty
table gives an empty result; other columns of the table are ignored by `scores` and kept by `keep_good`, which raises
ValueError if one is named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import crc_bucket, lean, values_of
from strataline.llm.words import mix, vocabulary

BITS = 18
TRAIN_ROWS = 8_000
EPOCHS = 3
HELD_OUT_FIFTH = 5
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
_SALTS = {name: np.uint64(i * 0x9E3779B97F4A7C15 % 2**64) for i, name in enumerate(("word", "pair", "shape", "shape pair", "other"), 1)}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct weight indices and their values."""
    mask = np.uint64((1 << BITS) - 1)
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    length = int(mix(np.array([_SALTS["other"]]), np.array([n.bit_length()], np.uint64))[0] & mask)
    if not n:
        return np.array([length]), np.array([1.0])
    vocab = vocabulary(with_shapes=True)
    numbers = vocab.numbers(words)
    h, s = vocab.hashes[numbers], vocab.shapes[numbers]
    parts = [h ^ _SALTS["word"], mix(h[:-1], h[1:]) ^ _SALTS["pair"], s ^ _SALTS["shape"], mix(s[:-1], s[1:]) ^ _SALTS["shape pair"]]
    index, counts = np.unique((np.concatenate(parts) & mask).astype(np.int64), return_counts=True)
    repeated = 0.0
    if n > 3:
        windows = np.sort(mix(h[:-2], h[1:-1], h[2:]))
        repeated = float(np.count_nonzero(windows[1:] == windows[:-1])) / (n - 2)
    rest = int(mix(np.array([_SALTS["other"]]), np.array([99], np.uint64))[0] & mask)
    return np.concatenate([index, [length, rest]]), np.concatenate([counts / n, [1.0, 4 * repeated]])


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """FTRL-proximal over examples of (indices, values, label); returns the weights, the last one being the bias."""
    size = (1 << BITS) + 1
    z, squares = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(squares[i])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(examples))
        for k in order:
            index, values, label = examples[k]
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - label) * values
            sigma = (np.sqrt(squares[index] + g * g) - np.sqrt(squares[index])) / ALPHA
            z[index] += g - sigma * w
            squares[index] += g * g
    return weights(np.arange(size)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """Weights learned from at most train_rows labelled rows outside the held-out fifth; None without any."""
    usable = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where((crc_bucket("_id", HELD_OUT_FIFTH) != 0) & F.col("_label").isNotNull())
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "_label").limit(train_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_label", F.xxhash64("_text")).limit(train_rows)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for i, value, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                index, values = features(value)
                examples.append((i, np.append(index, 1 << BITS), np.append(values, 1.0), y))
        examples.sort(key=lambda e: (e[0], len(e[1]), e[3]))
        if examples:
            yield pa.RecordBatch.from_arrays([pa.array([train([e[1:] for e in examples]).tobytes()], pa.binary())], names=["weights"])

    found = rows.repartition(1).mapInArrow(lean(fitted), "weights binary").collect()
    return np.frombuffer(bytes(found[0][0]), np.float32) if found else None


def scores(docs: DataFrame, weights: np.ndarray | None, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """key (long) and score (double) of every row; with keep, the columns of docs and score."""
    if keep and "score" in docs.columns:
        raise ValueError("the table already has a column score")
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if w is not None:
                for k, value in enumerate(values_of(batch.column(batch.schema.get_field_index(text)))):
                    index, values = features(value)
                    out[k] = 1 / (1 + np.exp(-np.clip(w[index] @ values + w[-1], -30, 30)))
            columns = [*(batch.columns if keep else batch.columns[:1]), pa.array(out)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names if keep else batch.schema.names[:1]), "score"])

    if keep:
        return docs.mapInArrow(lean(score), docs.select("*", F.lit(0.5).alias("score")).schema)
    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(lean(score), f"`{key}` long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    return scores(docs, fit(docs, labels), keep=True).where(F.col("score") >= threshold).select(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(crc_bucket("doc_id", HELD_OUT_FIFTH) == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted")
    )
