"""Mixing sources to target weights: random keys, distributed prefix sums and an exact cut of every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiver.llm.common import NON_SPACE, materialise, text_of, word_count

#: Weights of the sources in the order of their names, repeating; words of the mix in hundredths of all words; most epochs of a source.
WEIGHTS, PERCENT, MOST_EPOCHS = (3, 1, 2), 150, 2
#: Leading hexadecimal digits of the random key that name a range of it.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """Words that each source gives: source, source_size, target.

    Targets are a common level times the weight, but at most MOST_EPOCHS times the source. Sources fill up in the order
    of limit / weight, so the level follows from sums over the sources that filled up before: one pass over the sources
    in place of resharing again and again.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")).withColumn("limit", F.col("source_size") * MOST_EPOCHS)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    open_ = weighed.select(
        "*",
        # in hundredths of a word, so that all sums are whole
        (F.sum("source_size").over(every) * PERCENT - F.coalesce(F.sum("limit").over(earlier), F.lit(0)) * 100).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("weights"),
    ).withColumn("level", F.col("left").cast("double") / (F.col("weights") * 100).cast("double"))
    full = F.col("limit").cast("double") <= F.col("level") * F.col("weight")
    # the level of the first source that does not fill up holds for all after it
    held = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    return open_.withColumn("held", held).select("source", "source_size", F.when(F.col("held").isNull(), F.col("limit").cast("double")).otherwise(F.col("held") * F.col("weight")).alias("target"))


def _random_key(seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def mix_sources(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Words that the mix takes from every document.

    Within a source, documents stand in the order of a random key of doc_id. Ranges of the key hold few documents each;
    sums inside a range plus the sums of the ranges before it give every document's place, and no task holds a source.
    A source gives whole epochs, then documents from the start of the order until its target, rounded down, is reached
    to the word; the last one in part.

    Null source: a source of its own, last. Null text: size 0, nothing taken. Null doc_id: one key for all of them.
    Rows of equal key stand in the order of size; equal rows may swap places. A table without words: targets 0. Empty
    table: no rows. Columns besides doc_id, source and text are ignored. Returns doc_id, size, source_size, target, taken.
    """
    return _taken(docs, seed).select("doc_id", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, seed: str) -> DataFrame:
    key = _random_key(seed)
    sizes = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"), key.alias("key")).withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "sizes")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("words")).select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("range_start"))
    targets = source_targets(sizes)
    starts = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "range", "range_start", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range"))).select(
        "doc_id", "size", "source_size", "target", (F.col("range_start") + F.col("inside")).alias("start"), F.floor(F.col("target")).cast("long").alias("budget")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    return joined.withColumn("taken", whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("start"))))


def apply_mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix as documents: each row once for every epoch that takes it, the last copy cut to the words taken from it.

    Rows keep their columns. A document of which nothing is taken goes, except one without words, which stays as it is:
    it costs nothing. A row with null doc_id can't be traced and stays once.
    """
    part = _taken(docs, seed).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("size").alias("_q_size"), F.max("taken").alias("_q_taken"))
    joined = docs.join(part.withColumnRenamed("doc_id", "_q_id"), F.col("doc_id") == F.col("_q_id"), "left")
    whole = F.when(F.col("_q_size") > 0, F.floor(F.col("_q_taken") / F.greatest(F.col("_q_size"), F.lit(1)))).otherwise(1).cast("int")
    over = F.coalesce(F.col("_q_taken") - F.floor(F.col("_q_taken") / F.greatest(F.col("_q_size"), F.lit(1))) * F.col("_q_size"), F.lit(0))
    copies = joined.withColumn("_q_over", over).withColumn("_q_copies", F.coalesce(whole, F.lit(1)) + (F.col("_q_over") > 0).cast("int")).filter("_q_copies > 0")
    each = copies.withColumn("_q_copy", F.explode(F.sequence(F.lit(1), F.col("_q_copies"))))
    kept = F.when((F.col("_q_over") > 0) & (F.col("_q_copy") == F.col("_q_copies")), _first_words(F.col("text"), F.col("_q_over"))).otherwise(F.col("text"))
    return each.withColumn("text", kept).select(*docs.columns)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    gaps = F.split(text, f"{NON_SPACE}+")
    words = F.regexp_extract_all(text, F.lit(f"({NON_SPACE}+)"), F.lit(1))
    # zipped, as a lambda that looked up the gaps would cut the text again for every word
    return F.array_join(F.slice(F.zip_with(gaps, words, lambda gap, word: F.concat(gap, word)), 1, n.cast("int")), "")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(concat(CAST(doc_id AS VARCHAR), ':mix')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 2 AS lim, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () * 150 - coalesce(sum(lim) OVER f, 0) * 100 AS DOUBLE) / CAST((sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) * 100 AS DOUBLE) AS lvl
  FROM r WINDOW f AS (ORDER BY lim / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, first_value(CASE WHEN CAST(lim AS DOUBLE) > lvl * weight THEN lvl END IGNORE NULLS) OVER (ORDER BY lim / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM o),
t AS (SELECT source, source_size, CASE WHEN held IS NULL THEN CAST(lim AS DOUBLE) ELSE held * weight END AS target, CAST(floor(CASE WHEN held IS NULL THEN lim ELSE held * weight END) AS BIGINT) AS budget FROM h),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + least(size, greatest(0, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
