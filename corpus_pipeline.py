"""The corpus pipeline: documents pass through five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.common import materialise, read_table
from quiver.llm.decontamination import find_items
from quiver.llm.mixing import apply_mix
from quiver.llm.near_dedup import near_duplicates
from quiver.llm.quality_classifier import score_quality
from quiver.llm.queries import SHARDS
from quiver.llm.sharding import shard_documents

#: Ids of dropped documents are broadcast up to so many (8 bytes each); beyond, both sides are shuffled.
MOST_BROADCAST = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among the ids; null is never among them."""
    gone = materialise(ids.filter("doc_id IS NOT NULL").distinct().select(F.col("doc_id").alias("_q_gone")), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, docs["doc_id"] == F.col("_q_gone"), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null or empty text is judged like any other, null doc_id too; repeated rows have one verdict. Without both labels
    all documents stay. Empty table: no rows. Other columns pass, whatever their names.
    """
    judged = score_quality(docs, read_table(spark, sf_dir, "labels"), extra=docs.columns)
    return judged.filter("predicted = 1").select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; rows that repeat it go.

    Null or empty text and null doc_id: in no group, the row stays. Of rows that share a doc_id one stays. Empty table:
    no rows. Other columns pass, whatever their names.
    """
    judged = materialise(near_duplicates(docs).select("doc_id", "kept"), "judged")
    rest = _without(docs, judged.filter("NOT kept"))
    repeated = materialise(judged.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return rest
    once = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return _without(rest, repeated).unionByName(once.join(judged.filter("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null or empty text holds none. Of rows that share a doc_id, all go if one holds an item; rows with null doc_id are
    not identified and stay. Empty tables: nothing goes. Other columns pass, whatever their names.
    """
    return _without(docs, find_items(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources give their share of words: documents repeat by epochs, the one at the cut in part.

    Null source: one of its own. Rows without words stay once, as do rows with null doc_id. Rows that share a doc_id are
    taken as often as the most taken of them. Empty table: no rows. Other columns pass, whatever their names.
    """
    return apply_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row goes to its shard.

    Null doc_id: one shard for all of them. Null text: size 16. Repeated rows: one shard, slots of their own. Empty
    table: no rows. Other columns go.
    """
    return shard_documents(docs, SHARDS)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't train the classifier or jump through shards; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents; what each returns is written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
