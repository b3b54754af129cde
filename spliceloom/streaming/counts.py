"""Allele counts over a stream of classified reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evidence import CLASSES


def stream_allele_counts(evidence: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Reads of each allele class by variant and time window; late reads are taken until the watermark passes.

    Works on static DataFrames as well. Fragments need exact distinct names, whose
    state has no bound in a stream, so they stay a batch operator.
    """
    sums = [F.coalesce(F.sum(F.when(F.col("allele_class") == c, F.col("source_read_count"))), F.lit(0)).cast("long").alias(f"num_{c}_reads") for c in CLASSES]
    windows = evidence.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "variant_id").agg(*sums)
    return windows.select(F.col("w.start").alias("window_start"), "variant_id", *[f"num_{c}_reads" for c in CLASSES])
