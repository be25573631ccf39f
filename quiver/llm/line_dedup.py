"""Repeated lines by a sharded minimal perfect hash, whose fingerprint and count arrays documents probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import materialise, ship_by_value, text_of
from quiver.llm.shingles import as_bytes, mix, slices

ship_by_value(__name__)

#: A line counts from so many code points on, and goes if so many documents hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys that a shard of the hash holds on average, which bounds what a task builds and holds.
SHARD_KEYS = 100_000
#: Probes that one copy of a shard answers; a shard with a line of very many documents is copied more often.
PROBES_OF_COPY = 1_000_000
#: Shards whose number of copies is broadcast; beyond, it is joined.
MOST_BROADCAST = 100_000

_SPACE = b" \t\n\x0b\x0c\r"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys in levels (Limasset et al., 2017): a key sits in the first level where no other key shares its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate([[0], np.cumsum(bits)[:-1]]).astype(np.int64))
            total += int(bits.sum())
        self.size = total

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            bits = 2 * len(left) + 1
            at = cls._place(left, len(levels), bits)
            taken = np.bincount(at, minlength=bits)
            levels.append((taken == 1).astype(np.uint8))
            left = left[taken[at] != 1]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key from 0 to size - 1; any index, or -1, for keys that were never put in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(keys[open_], level, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,) = np.frombuffer(data, np.int64, 1)
        sizes, at, levels = np.frombuffer(data, np.int64, int(n), 8), 8 * (int(n) + 1), []
        for size in map(int, sizes):
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size))
            at += width
        return cls(levels)


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (h >> 64) - (1 << 63)


def _long_key(line: bytes) -> bytes | None:
    """The key of a line that counts, else None."""
    if len(line) < LEAST_CHARS:
        return None
    key = line_key(line)
    if len(key) < LEAST_CHARS or (not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST_CHARS):
        return None
    return key


def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hash of each distinct long line of a document."""
    for batch in slices(batches):
        ids = batch.column(0).to_pylist()
        out = ([], [], [])
        for doc, text in zip(ids, as_bytes(batch.column(1)), strict=True):
            for h, fingerprint in {_hash(k) for k in map(_long_key, text.split(b"\n")) if k is not None}:
                out[0].append(doc), out[1].append(h), out[2].append(fingerprint)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "h", "fingerprint"])


def _compact(fingerprints: np.ndarray) -> np.ndarray:
    """32 bits of a fingerprint."""
    return (fingerprints.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    """One shard: the perfect hash of its keys, and by its index compact fingerprints, counts up to 255 and largest documents."""
    # of keys that share the 64 bits of h, which 1e9 lines do once in 37 tables, the later ones get hashes of their own
    order = keys.groupby("h").cumcount().to_numpy()
    rows = []
    for layer in range(int(order.max()) + 1):
        part = keys[order == layer]
        h = part["h"].to_numpy(np.int64).view(np.uint64)
        phf = PerfectHash.build(h)
        at = phf(h)
        arrays = []
        for values in (_compact(part["fingerprint"].to_numpy()), np.minimum(part["n"].to_numpy(), 255).astype(np.uint8), part["last"].to_numpy(np.int64)):
            x = np.zeros(len(h), values.dtype)
            x[at] = values
            arrays.append(x.tobytes())
        rows.append((int(keys["shard"].iloc[0]), phf.to_bytes(), *arrays))
    return pd.DataFrame(rows, columns=["shard", "phf", "fingerprints", "counts", "lasts"])


def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (shard, part): the shard's arrays stand first, then (doc_id, h, fingerprint) rows probe them, and those of dropped lines come out."""
    held, of = [], None
    for batch in batches:
        shard, part = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
        is_index = batch.column("phf").is_valid().to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(shard)]
        doc, h, fp = (batch.column(c).fill_null(0).to_numpy() for c in ("doc_id", "h", "fingerprint"))
        drop = np.zeros(len(shard), bool)
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if start == end:
                continue
            if (shard[start], part[start]) != of:
                held, of = [], (shard[start], part[start])
            for i in start + np.flatnonzero(is_index[start:end]):
                kinds = (("fingerprints", np.uint32), ("counts", np.uint8), ("lasts", np.int64))
                held.append((PerfectHash.from_bytes(batch.column("phf")[int(i)].as_py()), *(np.frombuffer(batch.column(c)[int(i)].as_py(), t) for c, t in kinds)))
            here = start + np.flatnonzero(~is_index[start:end])
            for phf, fingerprints, counts, lasts in held if len(here) else ():
                at = phf(h[here].view(np.uint64))
                known = np.maximum(at, 0)
                drop[here] |= (at >= 0) & (fingerprints[known] == _compact(fp[here])) & (counts[known] >= LEAST_DOCS) & (lasts[known] != doc[here])
        yield pa.RecordBatch.from_arrays([pa.array(doc[drop]), pa.array(h[drop]), pa.array(fp[drop])], ["doc_id", "h", "fingerprint"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their dropped lines, and the counts."""
    for batch in slices(batches):
        kept, total, dropped = [], [], []
        for text, gone in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = {(x["h"], x["fingerprint"]) for x in gone or ()}
            stay = lines if not gone else [x for x in lines if (k := _long_key(x)) is None or _hash(k) not in gone]
            kept.append(b"\n".join(stay).decode("utf-8", "replace")), total.append(len(lines)), dropped.append(len(lines) - len(stay))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without the long lines that many documents hold; the largest doc_id of a line keeps it.

    1. The distinct long lines of each document, as 128-bit hashes, are counted over documents.
    2. All distinct line hashes are dealt to shards; each builds its minimal perfect hash and arrays of fingerprints,
       counts and largest documents, 13 bytes and a few bits a line.
    3. The documents' hashes are dealt to (shard, part), where they stream past the shard's arrays, whose counts decide:
       memory holds one shard, and no line is joined with its copies. A shard has a copy for every PROBES_OF_COPY probes,
       so a line of very many documents spreads.

    A line that is told from others by fewer bits than it has would need two lines that agree in 96 bits of their hash.

    Null or empty text: one empty line. Null doc_id: its lines neither count nor go. Rows that share a doc_id count as
    one document. Empty table: no rows. Columns besides doc_id and text are ignored. Returns doc_id, n_lines,
    n_dropped, text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    lines = materialise(texts.filter("doc_id IS NOT NULL").mapInArrow(line_hashes, "doc_id long, h long, fingerprint long"), "lines")
    once = lines.distinct()
    counted = materialise(once.groupBy("h", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "counted")
    shards = 1 + counted.count() // SHARD_KEYS
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard")
    keys = counted.select(shard, "h", "fingerprint", "n", "last")
    copies = materialise(keys.groupBy("shard").agg(F.ceil(F.sum("n") / PROBES_OF_COPY).cast("int").alias("copies")), "copies")
    copies = F.broadcast(copies) if shards <= MOST_BROADCAST else copies
    index = keys.groupBy("shard").applyInPandas(build_shard, "shard int, phf binary, fingerprints binary, counts binary, lasts binary")
    empty = [F.lit(None).cast("binary").alias(c) for c in ("phf", "fingerprints", "counts", "lasts")]
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("copies")).cast("int").alias("part")
    asked = once.select(shard, "doc_id", "h", "fingerprint").join(copies, "shard").select("shard", part, F.lit(1).alias("turn"), "doc_id", "h", "fingerprint", *empty)
    each = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part")
    held = index.join(copies, "shard").select("shard", each, F.lit(0).alias("turn"), *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "h", "fingerprint")), "phf", "fingerprints", "counts", "lasts")
    dealt = held.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "turn")
    gone = materialise(dealt.mapInArrow(probe, "doc_id long, h long, fingerprint long").groupBy("doc_id").agg(F.collect_set(F.struct("h", "fingerprint")).alias("gone")), "gone")
    # a merge join at every size: the texts move once, and no plan changes as the table grows
    return texts.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_rewrite, "doc_id long, n_lines long, n_dropped long, text string")


ORACLE = """
WITH l AS (
  SELECT doc_id, i, line, lower_a AS k FROM (
    SELECT doc_id, i, line, translate(trim(line, E' \\t\\n\\x0B\\x0C\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_a
    FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (c.k IS NOT NULL AND doc_id <> last) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY doc_id
"""
