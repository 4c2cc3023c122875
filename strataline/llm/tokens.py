"""Token ids of whole texts, and their cutting into pieces."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import worker_cache

#: The vocabulary's file; its ids are those that `tokenizers` gives with add_special_tokens=False.
VOCABULARY = "byte_bpe_50k.json"
#: Its byte-level pre-tokenizer, in a form without backtracking; the same cuts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END_ID = 0
CAPACITY = 2048


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable bytes are their own, the others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def _load(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE file, whose ids are in the order of its merges; its added tokens are recognised in texts."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    added = {t["content"]: t["id"] for t in found["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): number for token, number in found["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encoding_of(path: str) -> tiktoken.Encoding:
    return worker_cache("encoding " + path, lambda: _load(path))


def id_bytes(path: str) -> int:
    """Bytes of an id in packed matrices: two, or four where the vocabulary has ids of 65,535 and more."""
    return 2 if encoding_of(path).max_token_value < 0xFFFF else 4


def document_ids(text: str | None, path: str) -> np.ndarray:
    """Unsigned 32-bit ids of the text, names of added tokens being these tokens, and the end id."""
    ids = encoding_of(path).encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: all of capacity but perhaps the first."""
    start, length = 0, (n - 1) % capacity + 1
    while start < n:
        yield start, length
        start, length = start + length, capacity


def pieces_of(batch: pa.RecordBatch, path: str, capacity: int) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, piece, start, ids) of every piece of a batch of doc_id and text."""
    texts = batch.column(1)
    for row, doc_id in enumerate(batch.column(0).to_pylist()):
        ids = document_ids(texts[row].as_py(), path)
        for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
            yield doc_id, piece, start, ids[start : start + length]


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
