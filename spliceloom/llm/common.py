"""Helpers that several operators share: shared scratch tables, word counts, row folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words.
WHITE = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local runs, tests) a temporary folder of this machine takes its place.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again.

    Cuts the lineage: a later stage that loses an executor reads files rather
    than computing everything anew, and a random plan choice is made once.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ``WHITE``; null counts as 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE[1:], " " * (len(WHITE) - 1))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def squeeze(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def fold(key: Column, folds: int) -> Column:
    """Remainder of crc32 of the key as text; a null key falls in fold 1, never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(1))
