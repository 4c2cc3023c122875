"""Words of whole texts as hash arrays, for worker code."""

from __future__ import annotations

import numpy as np
import xxhash

from strataline.llm.common import worker_cache, worker_forget

#: Distinct words that a worker remembers before it starts afresh; bounds its memory.
VOCABULARY = 400_000
_CLASSES = bytes(
    ord("a") if chr(i).islower() and i < 128 else ord("A") if chr(i).isupper() and i < 128 else ord("9") if 48 <= i < 58 else ord("a") if i >= 128 else i for i in range(256)
)


class Vocabulary(dict):
    """Word bytes to a small number; hashes[number] is the word's 64-bit hash, shapes[number] that of its shape, if asked for."""

    def __init__(self, with_shapes: bool) -> None:
        super().__init__()
        self.with_shapes = with_shapes
        self.hashes, self.shapes = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.shapes = np.concatenate([self.shapes, np.zeros_like(self.shapes)])
        self.hashes[number] = xxhash.xxh64_intdigest(word)
        if self.with_shapes:
            shape = word.translate(_CLASSES)
            self.shapes[number] = xxhash.xxh64_intdigest(shape[:1] + b" " + shape[-3:])
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > VOCABULARY:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def vocabulary(with_shapes: bool = False) -> Vocabulary:
    """The worker's vocabulary. It holds one of a kind at a time: stages follow each other in the same workers."""
    worker_forget(f"vocabulary {not with_shapes}")
    return worker_cache(f"vocabulary {with_shapes}", lambda: Vocabulary(with_shapes))


def mix(*parts: np.ndarray) -> np.ndarray:
    """One well-mixed 64-bit hash of aligned arrays of hashes, order-sensitive."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out ^= part
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out
