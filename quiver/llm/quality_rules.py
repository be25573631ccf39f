"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds (after Angelopoulos et al., "Learn then Test", 2021)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import NON_SPACE, SPACE, materialise, text_of, word_array

#: In each stratum at most this share of good documents may fall to the rules, with this chance of being wrong anywhere.
FALSE_REJECTIONS, ERROR = 0.05, 0.05
#: Levels that are tried, from the most lenient on: at a level a document falls if one of its shares is above that quantile of the good documents that set the cutoffs.
LEVELS = (1.0, 0.9975, 0.995, 0.99, 0.985, 0.98, 0.97)
RULES = ("symbols", "capitals", "dup_lines", "repeat_words")
#: Strata whose cutoffs are broadcast; beyond, they are joined.
MOST_STRATA = 10_000


def _covered_by_repeats(grams: str) -> Column:
    """Words inside 3-word windows that occur twice or more, from the sorted windows (hash, words, place): equal ones stand together."""
    same = lambda v, u: F.coalesce((v["h"] == u["h"]) & (v["a"] == u["a"]) & (v["b"] == u["b"]) & (v["c"] == u["c"]), F.lit(False))
    repeated = F.filter(F.col(grams), lambda v, k: same(v, F.get(F.col(grams), k - 1)) | same(v, F.get(F.col(grams), k + 1)))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-3).alias("last"))
    step = lambda acc, p: F.struct((acc["covered"] + F.least(F.lit(3), p - acc["last"])).alias("covered"), p.alias("last"))
    return F.aggregate(F.sort_array(F.transform(repeated, lambda v: v["place"])), start, step, lambda acc: acc["covered"])


def base_counts(docs: DataFrame) -> DataFrame:
    """The counts of the contract, and what the rules need besides: doc_id, stratum and counts."""
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text_of().alias("text"))
    cut = texts.select("*", word_array(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(NON_SPACE)).alias("lines"))
    i = F.sequence(F.lit(0), F.size("w") - 3)
    at = lambda k, j: F.get(F.col("w"), k + j)
    windows = F.transform(i, lambda k: F.struct(F.xxhash64(at(k, 0), at(k, 1), at(k, 2)).alias("h"), at(k, 0).alias("a"), at(k, 1).alias("b"), at(k, 2).alias("c"), k.alias("place")))
    grams = cut.select("*", F.when(F.size("w") >= 3, F.sort_array(windows)).alias("grams"))
    squeezed = F.regexp_replace("text", f"{SPACE}+", "")
    return grams.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("grams").isNull(), F.lit(0)).otherwise(_covered_by_repeats("grams")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )


def rule_shares() -> dict[str, Column]:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": part("n_symbols", "word_chars"), "capitals": part("n_capitals", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeat_words": part("n_repeat_words", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p: the exact test that the true rate is not p or more."""
    n = n.cast("double")
    log0 = n * math.log1p(-p)
    step = lambda acc, i: F.struct((acc["l"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))).alias("l"), acc["s"].alias("s"))

    def add(acc: Column, i: Column) -> Column:
        moved = step(acc, i.cast("double"))
        return F.struct(moved["l"].alias("l"), (acc["s"] + F.exp(moved["l"])).alias("s"))

    start = F.struct(log0.alias("l"), F.exp(log0).alias("s"))
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add, lambda acc: acc["s"])


def _few(by_stratum: DataFrame) -> DataFrame:
    """Marked for broadcast if there are few strata."""
    by_stratum = materialise(by_stratum, "strata")
    return F.broadcast(by_stratum) if by_stratum.count() <= MOST_STRATA else by_stratum


def select_cutoffs(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Per stratum and rule the strictest cutoff that the holdouts allow: stratum, cut_<rule> (null: the rule is off).

    Good holdouts are dealt to two halves by hash of doc_id. Quantiles of the first half give every level its cutoffs,
    one for each rule; being drawn from other documents, they make no claim. The second half tests the levels: documents
    that fall to any rule are counted, and the exact binomial tail must rule out a true rate of FALSE_REJECTIONS or more.
    Levels are tried in their fixed order and the first failure ends the search, which needs no correction; strata share
    ERROR by Bonferroni. Documents that fail the base rules are left out.
    """
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = counts.filter(~base_failed()).join(good, "doc_id").select("stratum", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("first"), *(c.alias(r) for r, c in rule_shares().items()))
    held = materialise(held, "holdouts")
    cuts = _few(held.filter("first").groupBy("stratum").agg(*(F.percentile_approx(r, list(LEVELS), 10_000).alias(f"at_{r}") for r in RULES)))
    tested = held.filter("NOT first").join(cuts, "stratum")
    falls = lambda k: sum(((F.col(r) > F.get(f"at_{r}", F.lit(k))).cast("int") for r in RULES), F.lit(0)) > 0
    sums = tested.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(falls(k).cast("long")) for k in range(len(LEVELS)))).alias("fallen"))
    tests = sums.crossJoin(F.broadcast(sums.agg(F.count(F.lit(1)).alias("tests"))))  # the right side is a single row
    fails = F.transform("fallen", lambda k: F.when(k > F.col("n") * FALSE_REJECTIONS, F.lit(True)).otherwise(binomial_tail(k, F.col("n"), FALSE_REJECTIONS) > ERROR / F.col("tests")))
    first = F.array_position(fails, True)
    passed = F.when(first == 0, F.lit(len(LEVELS))).otherwise(first - 1).cast("int")
    chosen = tests.select("stratum", passed.alias("passed")).join(cuts, "stratum")
    return chosen.select("stratum", *(F.get(f"at_{r}", F.col("passed") - 1).alias(f"cut_{r}") for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every document and whether it stays.

    Strata are the values of lang, null as one of its own. Without enough good holdouts a stratum keeps all that pass
    the base rules. Null or empty text: no words, base_failed. Null doc_id or no label: judged, never a holdout.
    Repeated rows: the same verdict; labels that contradict each other count as bad. Empty table: no rows. Columns
    besides doc_id, text and lang are ignored. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.
    """
    counts = materialise(base_counts(docs), "counts")
    cutoffs = _few(select_cutoffs(counts, labels))
    caught = F.lit(False)
    for rule, share in rule_shares().items():
        caught = caught | F.coalesce(share > F.col(f"cut_{rule}"), F.lit(False))
    return counts.join(cutoffs, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~caught).alias("kept")
    )
