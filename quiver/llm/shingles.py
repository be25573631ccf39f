"""Word shingles as 64-bit hashes, vectorised with numpy; runs in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from quiver.llm.common import ship_by_value

ship_by_value(__name__)

#: Words of a shingle.
SHINGLE = 5
#: Rows of a batch that are in Python's hands at once.
SLICE = 256

_ODD = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all beyond ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_MIX_1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_MIX_2)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of the shingle at each place; of fewer words than a shingle has, one hash of them all; of no words, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, width)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * np.uint64(_ODD) + words[j : n - width + 1 + j]
    return mix(out)


def contract_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space: exactly what bytes.lower() and bytes.split() do."""
    return text.lower().split()


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(hashes.of(contract_words(text))))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of a string column, one value at a time; null counts as empty."""
    return (x.as_py() or b"" for x in column.cast(pa.binary()))
