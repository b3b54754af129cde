"""Counts, fractions and ratios of alleles; unique sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import left_part, right_part, safe_ratio

CLASSES = ("ref", "alt", "other")
RATIOS = (("other", "ref"), ("other", "alt"), ("ref", "other"), ("alt", "other"))
UNITS = ("reads", "fragments")


def allele_counts(evidence: DataFrame, keys: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """Reads (with multiplicity) and distinct fragments of each allele class per key.

    ``evidence`` has the keys, allele_class, name and source_read_count. A name in
    two classes counts once in the total, so fractions of fragments can sum to
    more than 1. Exact: one aggregation over distinct names.
    """
    of = lambda c, x: F.when(F.col("allele_class") == c, F.col(x))
    sums = {f"num_{c}_reads": F.coalesce(F.sum(of(c, "source_read_count")), F.lit(0)).cast("long") for c in CLASSES}
    # Names are made distinct by (key, name) first, so one hot locus spreads over all tasks.
    flags = {f"_{c}": F.max((F.col("allele_class") == c).cast("long")) for c in CLASSES}
    by_name = evidence.groupBy(*keys, "name").agg(*[x.alias(k) for k, x in {**sums, **flags}.items()])
    return by_name.groupBy(*keys).agg(
        *[F.sum(f"num_{c}_reads").alias(f"num_{c}_reads") for c in CLASSES],
        *[F.coalesce(F.sum(F.when(F.col("name").isNotNull(), F.col(f"_{c}"))), F.lit(0)).alias(f"num_{c}_fragments") for c in CLASSES],
        F.count("name").alias("num_total_fragments"),
    )


def with_fractions(counts: DataFrame) -> DataFrame:
    """Counts with totals, fractions and ratios; 0 over anything is 0, anything else over 0 is infinite."""
    totals = counts.withColumn("num_total_reads", sum((F.col(f"num_{c}_reads") for c in CLASSES[1:]), F.col("num_ref_reads")))
    new = {f"fraction_{c}_{u}": safe_ratio(F.col(f"num_{c}_{u}"), F.col(f"num_total_{u}")) for c in CLASSES for u in UNITS}
    new |= {f"ratio_{a}_to_{b}_{u}": safe_ratio(F.col(f"num_{a}_{u}"), F.col(f"num_{b}_{u}")) for a, b in RATIOS for u in UNITS}
    return totals.withColumns(new)


def counts_for_variants(variants: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts of every variant, 0 where it has no reads."""
    found = variants.select("variant_id").join(allele_counts(evidence), "variant_id", "left").na.fill(0)
    return with_fractions(found)


#: What makes up a read beside its variant; ``name`` alone does not tell reads of one fragment apart.
READ = ("prefix", "allele", "suffix", "name", "source_read_count")


def distinct_reads(reads: DataFrame, max_prefix: Column | None, max_suffix: Column | None) -> DataFrame:
    """Each distinct read of a variant once: the columns of ``READ``, its first read_ordinal, and its clipped surroundings ``p`` and ``s``."""
    found = reads.groupBy("variant_id", *READ).agg(F.min("read_ordinal").alias("read_ordinal"))
    prefix = F.col("prefix") if max_prefix is None else right_part(F.col("prefix"), max_prefix)
    suffix = F.col("suffix") if max_suffix is None else left_part(F.col("suffix"), max_suffix)
    return found.withColumns({"p": prefix, "s": suffix})


def unique_sequences(reads: DataFrame, max_prefix: int | None, max_suffix: int | None) -> DataFrame:
    """Distinct (prefix, allele, suffix) of clipped reads with the number of distinct reads that have them.

    A size of None or 0 does not clip. Columns: variant_id, prefix, alt, suffix, n_reads, seen (first ordinal). The reads
    themselves are those of ``distinct_reads`` with the same p, allele and s.
    """
    rows = distinct_reads(reads, F.lit(max_prefix) if max_prefix else None, F.lit(max_suffix) if max_suffix else None)
    grouped = rows.groupBy("variant_id", "p", F.col("allele").alias("alt"), "s").agg(F.count("*").alias("n_reads"), F.min("read_ordinal").alias("seen"))
    return grouped.withColumnsRenamed({"p": "prefix", "s": "suffix"})
