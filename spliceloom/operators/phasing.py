"""Phasing of variants that share fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import stage_table


def shared_names(names: DataFrame, key: str = "variant_id", name: str = "name", block: int = 512) -> DataFrame:
    """(a, b, n): variants and the number of distinct names both have, a < b.

    Pairs come only from names that several variants have. A name with up to ``block`` variants makes its pairs in a
    row; the variants of others are dealt to blocks, and each pair of blocks is a task's work of its own.
    """
    distinct = names.select(F.col(key).alias("v"), F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    counted = stage_table(distinct.withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n > 1"), "shared-names")

    few = counted.where(F.col("n") <= block).groupBy("name").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    firsts = few.select("vs", F.posexplode("vs").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("b"))

    many = counted.where(F.col("n") > block)
    if not many.limit(1).count():
        return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    many = many.withColumn("blocks", F.ceil(F.col("n") / block))
    many = many.withColumn("mine", F.pmod(F.xxhash64("v"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = many.select("v", "name", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    left = dealt.where("mine = low").select(F.col("v").alias("x"), "name", "low", "high")
    right = dealt.where("mine = high").select(F.col("v").alias("y"), "name", "low", "high")
    # Within a block a pair meets in both orders, between two blocks once.
    met = left.join(right, ["name", "low", "high"]).where("low < high OR x < y")
    pairs = pairs.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def phased_pairs(counts: DataFrame, least: int = 2) -> DataFrame:
    """Pairs with at least ``least`` shared names."""
    return counts.where(F.col("n") >= least)


def partners(pairs: DataFrame) -> DataFrame:
    """(variant_id, partners): variants paired directly, sorted."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("variant_id")).agg(F.sort_array(F.collect_set("b")).alias("partners"))


def phase_components(pairs: DataFrame) -> DataFrame:
    """(variant_id, phase_group): connected components; the group is its smallest variant.

    Each round takes the smallest label of all neighbours and then the label's own
    label, so paths shorten by half, until no label changes. Rounds are written to
    the shared folder. Variants without partner have no row.
    """
    edges = stage_table(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "phase-edges")
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("v"), "label")
    labels, changed = stage_table(labels, "phase-labels"), True
    while changed:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v", "left").select("v", F.least("label", F.coalesce("near", "label")).alias("m"), F.col("label").alias("old"))
        jump = lower.select(F.col("v").alias("m"), F.col("m").alias("next"))
        moved = stage_table(lower.join(jump, "m", "left").select("v", "old", F.least("m", F.coalesce("next", "m")).alias("label")), "phase-labels")
        changed = moved.where("label <> old").limit(1).count() > 0
        labels = moved.select("v", "label")
    return labels.select(F.col("v").alias("variant_id"), F.col("label").alias("phase_group"))


def phase_groups(pairs: DataFrame, names: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """One row per phase group.

    ``names`` is (variant_id, name); supporting names are those of two or more of
    the group's variants. ``proteins`` (top protein per variant) adds the sorted
    unions of cDNA sequences, mutant proteins and transcripts. There are no
    germline variants in the input, so that list is empty.
    """
    groups = phase_components(pairs)
    members = groups.groupBy("phase_group").agg(F.sort_array(F.collect_set("variant_id")).alias("somatic_variants"))
    by_name = groups.join(names.select("variant_id", "name").distinct(), "variant_id").groupBy("phase_group", "name").agg(F.count("*").alias("n"))
    support = by_name.where("n >= 2").groupBy("phase_group").agg(F.sort_array(F.collect_set("name")).alias("supporting_read_names"))
    empty = F.array().cast("array<string>")
    out = members.join(support, "phase_group", "left").withColumns(
        {
            "germline_variants": F.array().cast(members.schema["somatic_variants"].dataType),
            "supporting_read_names": F.coalesce("supporting_read_names", empty),
        }
    )
    if proteins is not None:
        joined = groups.join(proteins, "variant_id")
        flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
        more = joined.groupBy("phase_group").agg(
            flat("cdna_sequences").alias("cdna_sequences"),
            F.sort_array(F.collect_set(F.when(F.col("contains_mutation"), F.col("amino_acids")))).alias("mutant_protein_sequences"),
            flat("transcript_ids").alias("transcript_ids"),
            flat("transcript_names").alias("transcript_names"),
        )
        out = out.join(more, "phase_group", "left")
        out = out.withColumns({c: F.coalesce(c, empty) for c in more.columns if c != "phase_group"})
    return out


def read_phasing(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """(variant_id, has_evidence, partners_in_cis) for look-ups by variant; no partners is an empty list."""
    found = results.select("variant_id", (F.col("num_alt_fragments") > 0).alias("has_evidence")).join(partners(pairs), "variant_id", "left")
    kind = found.schema["partners"].dataType
    return found.select("variant_id", "has_evidence", F.coalesce("partners", F.array().cast(kind)).alias("partners_in_cis"))
