"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character class of the ASCII white space that the contracts name.
SPACE = r"[ \t-\r]"
NON_SPACE = r"[^ \t-\r]"


def ship_by_value(module_name: str) -> None:
    """Python functions of the module travel with the job, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; where that is unset, a fresh one on one machine, an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quiver-')}"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/quiver-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z to lower case; all other characters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def word_array(text: Column) -> Column:
    """The words of the text: maximal runs of characters outside ASCII white space."""
    return F.regexp_extract_all(text, F.lit(f"({NON_SPACE}+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of words, without building them: every word becomes one mark, the rest goes."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"{NON_SPACE}+", "x"), f"{SPACE}+", "")).cast("long")
