"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``documents``. A stage's decisions are
per document id; documents without id can't be told apart and pass unchanged
through the stages that drop documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .mixing import mix_sources
from .ngram_join import jaccard_join
from .packing import pack
from .toxicity import score_toxicity


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose id is not among ``dropped`` (doc_id)."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, score_toxicity(docs, labels).where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays; of rows that repeat an id, one of the kept texts."""
    decided = exact_dedup(docs)
    left = _without(docs, decided.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept"))
    twice = decided.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL")
    repeated = left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return _without(left, twice).unionByName(repeated)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id."""
    return _without(docs, jaccard_join(docs).where("doc_id <> component_id"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: as many rows as come nearest to its words.

    The mix goes through a source in order, so at most one document of a source is
    taken in part. Documents of which the mix takes less than half of their words
    go; documents without words are in no mix and stay.
    """
    taken = mix_sources(docs).groupBy("doc_id").agg(F.max("taken").alias("taken"), F.max("size").alias("size"))
    passes = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    counted = taken.where("doc_id IS NOT NULL").select("doc_id", passes.alias("passes")).where("passes <> 1")
    changed = docs.join(counted.where("passes > 1"), "doc_id").withColumn("copy", F.explode(F.expr("sequence(1, passes)")))
    return _without(docs, counted).unionByName(changed.select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what the other stages kept."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]
