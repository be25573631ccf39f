"""Benchmark items inside documents: MinHash containment search partitioned by item size (after Zhu et al., "LSH Ensemble", 2016), checked on exact shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import ship_by_value, text_of, word_count
from quiver.llm.shingles import SHINGLE, WordHashes, as_bytes, shingles, slices

ship_by_value(__name__)

#: An item is in a document if this share, in hundredths, of its shingles is.
CONTAINED_PERCENT = 75
#: MinHash samples of an item. Of a window that holds 3/4 of the item, at least 0.176 of the union is shared, so no sample agrees with probability under 0.824**64 = 4e-6.
SAMPLES = 64
#: Words of items that one pass over the documents looks for; more items take more passes.
BLOCK_WORDS = 2_000_000

#: Bytes to words: A-Z to lower case, other ASCII characters than letters and digits to spaces, the rest as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: bytes, hashes: WordHashes) -> np.ndarray:
    return hashes.of(text.translate(_FOLD).split())


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20160701)
    return rng.integers(0, 1 << 64, SAMPLES, np.uint64)[:, None] | np.uint64(1), rng.integers(0, 1 << 64, SAMPLES, np.uint64)[:, None]


class ItemIndex:
    """MinHash samples of items, each item in the partition of its size (powers of two); an item of fewer words than a shingle has is one shingle of that width."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        a, b = _hash_functions()
        hashes = WordHashes()
        self.ids, self.sets, self.signatures, self.widths = [], [], [], []
        self.short: dict[int, dict[int, list[int | None]]] = {}
        samples, owners = [], []
        for item_id, text in items:
            words = _words(text, hashes)
            found = np.unique(shingles(words))
            if not len(found):
                continue
            if len(words) < SHINGLE:
                self.short.setdefault(len(words), {}).setdefault(int(found[0]), []).append(item_id)
                continue
            values = a * found + b
            low = values.argmin(axis=1)
            samples.append(np.unique(found[low])), owners.append(np.full(len(samples[-1]), len(self.ids)))
            self.ids.append(item_id), self.sets.append(found), self.signatures.append(values.min(axis=1)), self.widths.append(1 << int(len(found) - 1).bit_length())
        samples, owners = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (samples, owners))
        order = np.argsort(samples, kind="stable")
        self.samples, self.owners = samples[order], owners[order].astype(np.int64)
        self.keys = np.unique(self.samples)

    def short_items(self, words: np.ndarray) -> list[int | None]:
        """Short items whose words stand consecutively."""
        return [item for width, known in self.short.items() for h in np.unique(shingles(words, width)).tolist() for item in known.get(h, ())] if len(words) else []

    def candidates(self, places: np.ndarray) -> set[int]:
        """Items that share a MinHash sample with a window of the document.

        For a partition of width u the windows have 2u shingles and start every u, so each passage as long as an item
        lies in one whole. A sample can only agree where the item's own sampled shingle stands: other windows are skipped.
        """
        if not len(self.keys) or not len(places):
            return set()
        slot = np.minimum(np.searchsorted(self.keys, places), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[slot] == places)
        if not len(hits):
            return set()
        a, b = _hash_functions()
        first, last = np.searchsorted(self.samples, places[hits], "left"), np.searchsorted(self.samples, places[hits], "right")
        windows: dict[tuple[int, int], set[int]] = {}
        for at, lo, hi in zip(hits.tolist(), first.tolist(), last.tolist(), strict=True):
            for item in self.owners[lo:hi].tolist():
                u = self.widths[item]
                for w in {max(0, at // u - 1), at // u}:
                    windows.setdefault((u, w), set()).add(item)
        out: set[int] = set()
        for (u, w), items in windows.items():
            if items <= out:
                continue
            low = (a * places[w * u : w * u + 2 * u] + b).min(axis=1)
            out |= {i for i in items if (low == self.signatures[i]).any()}
        return out


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of documents and the benchmark items that they contain, by exact containment of word shingles.

    Words are runs of letters and digits without case, so line breaks and punctuation don't hide a passage. The items
    are a query set: they are cut into blocks of bounded size, and each block is sent past all documents once.

    Null or empty texts of either side: in no pair. An item of fewer words than a shingle has is one shingle of its own
    width, found wherever its words stand together. Null doc_id or item_id: reported as such. Items that share an id count
    as one with the best containment. Repeated documents: one pair. Empty tables: no rows. Columns besides doc_id, text
    and item_id, text are ignored. Returns doc_id, item_id, n_shingles, n_contained, containment.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    total = items.agg(F.sum(word_count(F.col("text"))).alias("n")).first()["n"] or 0
    blocks = 1 + total // BLOCK_WORDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(vars(ItemIndex([(r["item_id"], r["text"].encode()) for r in rows])))  # plain arrays: broadcasts are pickled by reference

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known, hashes = ItemIndex.__new__(ItemIndex), WordHashes()
            vars(known).update(index.value)
            for batch in slices(batches):
                out: tuple[list, ...] = ([], [], [], [])
                for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    words = _words(text, hashes)
                    for item in known.short_items(words):
                        for column, value in zip(out, (doc, item, 1, 1), strict=True):
                            column.append(value)
                    places = shingles(words)
                    near = known.candidates(places)
                    whole = np.unique(places) if near else places
                    for i in sorted(near):
                        both = len(np.intersect1d(known.sets[i], whole, assume_unique=True))
                        if 100 * both >= CONTAINED_PERCENT * len(known.sets[i]):
                            for column, value in zip(out, (doc, known.ids[i], len(known.sets[i]), both), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "item_id", "n_shingles", "n_contained"])

        part = texts.mapInArrow(search, "doc_id long, item_id long, n_shingles long, n_contained long")
        found = part if found is None else found.union(part)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_contained") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_contained")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.n_contained", "best.containment")
