"""The operators of this subpackage as queries over the whole of their tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import line_dedup, mixing, near_dedup, pii, sharding
from quiver.llm.common import read_table
from quiver.llm.decontamination import find_items
from quiver.llm.license_scan import scan_licenses
from quiver.llm.quality_classifier import score_quality
from quiver.llm.quality_rules import apply_rules
from quiver.llm.quotation import link_quotations
from quiver.llm.sharding import shard_documents

#: Production parameters.
SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(read_table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    base = pii.listed(F.filter("spans", lambda s: s["order"] < len(pii.PATTERNS)))
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("private"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quotation": op4_quotation,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_dedup": op10_near_dedup,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op1_sharding": sharding.oracle(SHARDS), "op7_mixing": mixing.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op10_near_dedup": near_dedup.ORACLE}
