"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quiver.llm.common import materialise, ship_by_value, text_of

ship_by_value(__name__)

#: Multiplier of the generator in the published algorithm (fixed value).
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each 64-bit key among ``shards``, and among one shard more.

    Both come from a single chain of jumps: the last jump below a count is the shard for that count, so appending
    a shard moves exactly the keys whose next jump lands on it.
    """
    state = keys.astype(np.uint64, copy=True)
    shard, grown = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    b = np.zeros(len(keys), np.int64)
    while len(live):
        with np.errstate(over="ignore"):
            state = state * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        jumped = ((b + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        shard[live[jumped < shards]] = jumped[jumped < shards]
        grown[live[jumped <= shards]] = jumped[jumped <= shards]
        more = jumped < shards
        live, state, b = live[more], state[more], jumped[more]
    return shard, grown


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown_shard) of a bigint column; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())]))
    def both(keys: pd.Series) -> pd.DataFrame:
        shard, grown = jump_hash(keys.fillna(0).to_numpy(np.int64).view(np.uint64), shards)
        return pd.DataFrame({"shard": shard.astype(np.int32), "grown_shard": grown.astype(np.int32)})

    return both(F.coalesce(key, F.lit(0).cast("long")))


def shard_documents(docs: DataFrame, shards: int, runs: int = 256) -> DataFrame:
    """Documents with their shard, a gapless slot in it, and the shard they would have with one more shard.

    The shard follows from doc_id and the number of shards alone (law ``key``). Slots number a shard's rows from 0. A
    shard is cut into ``runs`` hash runs, each numbered by itself and moved by the rows of the runs before it, so no
    task ever sorts a whole shard. The run hashes the text's checksum too: rows that share one doc_id spread out.

    Null doc_id: hashed like any other value, so all such rows share a shard. Null text: no bytes, checksum of the
    empty text. Repeated rows: same shard, different slots. Empty table: no rows. Columns besides doc_id and text are
    ignored. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = text_of()
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    ).withColumn("order_key", F.xxhash64("doc_id", "text_crc32", "size"))
    # written once: both the runs and their sizes read it, and the jumps are made once
    rows = materialise(rows.withColumn("placed", jump_shards(F.xxhash64("doc_id"), shards)), "placed").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "placed.shard", "placed.grown_shard", "order_key", F.pmod("order_key", F.lit(runs)).cast("int").alias("run")
    )
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * runs rows, whatever the input
    offsets = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "run").orderBy("order_key", "doc_id")
    numbered = rows.withColumn("at", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(F.broadcast(offsets) if shards * runs <= 100_000 else offsets, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("at") + F.col("offset")).alias("slot"), "grown_shard"
    )


# -- the same in SQL

#: Primes of the 64-bit xxHash (fixed values) and Spark's seed of it.
_PRIME_1, _PRIME_2, _PRIME_3, _PRIME_4, _PRIME_5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED = 42
#: Reversed polynomial of CRC-32 (fixed value).
_POLYNOMIAL = 0xEDB88320


def _crc_of_bits() -> list[int]:
    """The CRC-32 table at the powers of two; any other entry is the XOR of those of its bits."""
    out = []
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        out.append(value)
    return out


def oracle(shards: int, runs: int = 256) -> str:
    """DuckDB SQL of ``shard_documents``: CRC-32, xxHash and the chain of jumps in whole numbers modulo 2**64."""
    word = f"CAST({1 << 64} AS UHUGEINT)"
    times = lambda x, y: f"(({x}) * CAST({y} AS UHUGEINT) % {word})"
    rotated = lambda x, n: f"(({x}) * {1 << n} % {word} + ({x}) // {1 << (64 - n)})"
    # one step of xxHash for each column: names are bound step by step, so no term is written twice
    steps = []
    for column, seed, out in (("doc_id", f"CAST({_SEED} AS UHUGEINT)", "key"), ("text_crc32", "key", "with_crc"), ("size", "with_crc", "order_key")):
        value = f"CAST((CAST({column} AS HUGEINT) + {1 << 64}) % {1 << 64} AS UHUGEINT)"
        chain = [
            f"{times(value, _PRIME_2)} AS a", f"{times(rotated('a', 31), _PRIME_1)} AS c", f"xor(({seed} + {_PRIME_5 + 8}) % {word}, c) AS d",
            f"({times(rotated('d', 27), _PRIME_1)} + {_PRIME_4}) % {word} AS e", f"{times('xor(e, e // ' + str(1 << 33) + ')', _PRIME_2)} AS f",
            f"{times('xor(f, f // ' + str(1 << 29) + ')', _PRIME_3)} AS g", f"CASE WHEN {column} IS NULL THEN {seed} ELSE xor(g, g // {1 << 32}) END AS {out}",
        ]
        steps.append(chain)
    hashed = "sized"
    for chain in steps:
        for step in chain[:-1]:
            hashed = f"(SELECT *, {step} FROM {hashed})"
        hashed = f"(SELECT * EXCLUDE (a, c, d, e, f, g), {chain[-1]} FROM {hashed})"
    folded = "s // 256"
    for bit, value in enumerate(_crc_of_bits()):
        folded = f"xor({folded}, xor(s, x) // {1 << bit} % 2 * {value})"
    return f"""
WITH RECURSIVE digits AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
octets AS (SELECT doc_id, size, list_transform(range(1, 2 * (size - 16), 2), lambda i: CAST(ascii(h[i]) - CASE WHEN h[i] > '9' THEN 55 ELSE 48 END AS BIGINT) * 16 + ascii(h[i + 1]) - CASE WHEN h[i + 1] > '9' THEN 55 ELSE 48 END) AS b FROM digits),
sized AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda s, x: {folded})) AS BIGINT) AS text_crc32 FROM octets),
hashed AS MATERIALIZED (SELECT * FROM {hashed}),
jumps AS (
  SELECT doc_id, size, text_crc32, order_key, key AS state, CAST(0 AS BIGINT) AS b, 0 AS shard, 0 AS grown_shard FROM hashed
  UNION ALL
  SELECT doc_id, size, text_crc32, order_key, state, j, CASE WHEN j < {shards} THEN j ELSE shard END, CASE WHEN j <= {shards} THEN j ELSE grown_shard END
  FROM (SELECT *, CAST(floor((b + 1) * (CAST({1 << 31} AS DOUBLE) / (CAST(state // {1 << 33} AS DOUBLE) + 1))) AS BIGINT) AS j
        FROM (SELECT * REPLACE (({times('state', JUMP_MULTIPLIER)} + 1) % {word} AS state) FROM jumps WHERE b < {shards})))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY (signed % {runs} + {runs}) % {runs}, signed, doc_id) - 1 AS BIGINT) AS slot
FROM (SELECT *, CAST(order_key AS HUGEINT) - CASE WHEN order_key >= {1 << 63} THEN CAST({1 << 64} AS HUGEINT) ELSE 0 END AS signed FROM jumps WHERE b >= {shards})
"""
