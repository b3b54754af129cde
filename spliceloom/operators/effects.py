"""Predicted effects of variants on proteins, from the transcript table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import is_mitochondrial, letters, reverse_complement, slice_text, translate
from ..functions.variants import short_description
from .contexts import interval_on_transcript, overlapping_transcripts

# Effect classes from least to most severe.
PRIORITY = (
    "Intergenic", "Intronic", "NoncodingTranscript", "IncompleteTranscript", "ThreePrimeUTR", "FivePrimeUTR", "Silent",
    "Substitution", "Insertion", "Deletion", "ComplexSubstitution", "StartLoss", "StopLoss", "PrematureStop", "FrameShift",
)
CHANGES_PROTEIN = PRIORITY[7:]


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two texts share."""
    same = F.zip_with(letters(a), letters(b), lambda x, y: x.eqNullSafe(y))
    # Bound to a name, so that it is laid out once.
    first = lambda flags: F.when(F.array_position(flags, False) > 0, F.array_position(flags, False) - 1).otherwise(F.size(flags))
    return F.get(F.transform(F.array(same), first), F.lit(0)).cast("int")


def transcript_effects(variants: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row per variant and overlapping transcript with effect_class and both proteins.

    The mutant protein is translated from the changed transcript. Exonic variants
    whose reference allele disagrees with the transcript, or whose changed transcript
    holds an unknown codon before its stop, count as incomplete.
    """
    rows = overlapping_transcripts(variants, transcripts)
    rows = rows.withColumn("i", interval_on_transcript(F.col("exons"), F.col("strand"), F.col("trimmed_pos"), F.col("trimmed_ref")))
    oriented = lambda c: F.when(F.col("strand") == "+", F.col(c)).otherwise(reverse_complement(F.col(c)))
    rows = rows.withColumns({"_start": F.col("i.start"), "_end": F.col("i.end"), "_ref": oriented("trimmed_ref"), "_alt": oriented("trimmed_alt")})
    seq, start, end, ref, alt = (F.col(c) for c in ("sequence", "_start", "_end", "_ref", "_alt"))
    first, stop = F.col("start_codon_offset"), F.col("stop_codon_offset")
    rows = rows.withColumn("_coding", F.coalesce(first.isNotNull() & stop.isNotNull() & (start >= first) & (start < stop + 3) & (slice_text(seq, start, end) == ref), F.lit(False)))
    coding = F.col("_coding")
    changed = F.concat(slice_text(seq, first, start), alt, slice_text(seq, end, F.length(seq)))
    rows = rows.withColumn("_changed", F.when(coding, changed))
    rows = rows.withColumn("_p", translate(F.col("_changed"), is_mitochondrial(F.col("contig")), F.lit(True)))
    before, after = F.col("protein"), F.col("_p.amino_acids")
    shift = F.abs(F.length(ref) - F.length(alt)) % 3 != 0
    same_start = F.startswith(after, F.substring(before, 1, 1))
    kind = (
        F.when(F.col("i").isNull(), "Intronic")
        .when(first.isNull() | stop.isNull(), "NoncodingTranscript")
        .when(start < first, "FivePrimeUTR")
        .when(start >= stop + 3, "ThreePrimeUTR")
        .when(~coding | after.isNull(), "IncompleteTranscript")
        .when(before == after, "Silent")
        .when(~same_start, "StartLoss")
        .when(shift, "FrameShift")
        .when(F.startswith(before, after), "PrematureStop")
        .when(F.startswith(after, before), "StopLoss")
        .when(F.length(ref) == F.length(alt), "Substitution")
        .when(F.length(alt) == 0, "Deletion")
        .when(F.length(ref) == 0, "Insertion")
        .otherwise("ComplexSubstitution")
    )
    n_prefix = shared_prefix(before, after)
    rows = rows.withColumns({"effect_class": kind, "_n": F.coalesce(n_prefix, F.lit(0))})
    n_prefix = F.col("_n")
    tail_a, tail_b = slice_text(before, n_prefix, F.length(before)), slice_text(after, n_prefix, F.length(after))
    rows = rows.withColumns({"_from": tail_a, "_to": tail_b})
    rows = rows.withColumn("_x", F.coalesce(shared_prefix(F.reverse(F.col("_from")), F.reverse(F.col("_to"))), F.lit(0)))
    n_suffix = F.col("_x")
    changes = F.col("effect_class").isin(*CHANGES_PROTEIN)
    mutated_end = F.when(F.col("effect_class") == "FrameShift", F.length(after)).otherwise(F.length(after) - n_suffix)
    rows = rows.withColumn("_e", F.greatest(mutated_end, n_prefix))
    old = slice_text(F.col("_from"), F.lit(0), F.length("_from") - F.col("_x"))
    new = slice_text(F.col("_to"), F.lit(0), F.length("_to") - F.col("_x"))
    place = (F.col("_n") + 1).cast("string")
    text = (
        F.when(F.col("effect_class") == "Silent", "silent")
        .when(F.col("effect_class") == "FrameShift", F.concat(F.lit("p."), F.substring("_from", 1, 1), place, F.lit("fs")))
        .when(F.col("effect_class") == "PrematureStop", F.concat(F.lit("p."), F.substring("_from", 1, 1), place, F.lit("*")))
        .when(F.col("effect_class") == "Insertion", F.concat(F.lit("p."), place, F.lit("ins"), new))
        .when(F.col("effect_class") == "Deletion", F.concat(F.lit("p."), old, place, F.lit("del")))
        .when(changes, F.concat(F.lit("p."), old, place, new))
        .otherwise(F.lower(F.col("effect_class")))
    )
    return rows.select(
        "variant_id",
        "effect_class",
        text.alias("effect_description"),
        changes.alias("modifies_protein_sequence"),
        *("gene_name", "gene_id", "transcript_id", "transcript_name"),
        F.when(changes | (F.col("effect_class") == "Silent"), before).alias("original_protein_sequence"),
        F.when(changes, F.col("_n")).alias("aa_mutation_start_offset"),
        F.when(changes, F.col("_e")).cast("int").alias("aa_mutation_end_offset"),
        F.when(changes, after).alias("mutant_protein_sequence"),
        (first.isNotNull() & stop.isNotNull()).alias("coding"),
        "complete",
        F.length("sequence").alias("transcript_length"),
    )


def top_effects(variants: DataFrame, effects: DataFrame, whitelist: list[str] | None = None) -> DataFrame:
    """The most severe effect of each variant; then complete, longer transcripts, then by id.

    A whitelist of transcripts is ignored for variants that it leaves without
    effect. Variants off all transcripts are Intergenic.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("effect_class")), F.lit(0))
    listed = F.col("transcript_id").isin(whitelist) if whitelist is not None else F.lit(True)
    order = Window.partitionBy("variant_id").orderBy(listed.desc(), rank.desc(), F.col("complete").desc_nulls_last(), F.desc("transcript_length"), "transcript_id")
    best = effects.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "complete", "transcript_length", "coding")
    joined = variants.select("variant_id").join(best, "variant_id", "left")
    return joined.withColumns(
        {
            "effect_class": F.coalesce("effect_class", F.lit("Intergenic")),
            "effect_description": F.coalesce("effect_description", F.lit("intergenic")),
            "modifies_protein_sequence": F.coalesce("modifies_protein_sequence", F.lit(False)),
        }
    )


def overlap_summary(effects: DataFrame) -> DataFrame:
    """Genes and transcripts over each variant, all and coding."""
    when = lambda c, f: F.sort_array(F.collect_set(F.when(c, F.col(f))))
    every, coding = F.lit(True), F.col("coding")
    return effects.groupBy("variant_id").agg(
        when(every, "gene_name").alias("overlapping_gene_names"),
        when(every, "gene_id").alias("overlapping_gene_ids"),
        when(coding, "gene_name").alias("overlapping_coding_gene_names"),
        when(coding, "gene_id").alias("overlapping_coding_gene_ids"),
        when(every, "transcript_id").alias("overlapping_transcript_ids"),
        when(coding, "transcript_id").alias("overlapping_coding_transcript_ids"),
    )


def described(variants: DataFrame) -> DataFrame:
    return variants.withColumn("variant", short_description(*(F.col(c) for c in ("contig", "pos", "ref", "alt"))))
