"""Edits of transcripts: those a variant predicts and those that reads show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import left_part, reverse_complement
from ..functions.scores import edit_runs
from .contexts import interval_on_transcript, overlapping_transcripts


def variant_edits(variants: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(variant_id, transcript_id, transcript_name, edit) of each variant on each transcript's exons."""
    rows = overlapping_transcripts(variants, transcripts)
    rows = rows.withColumn("i", interval_on_transcript(F.col("exons"), F.col("strand"), F.col("trimmed_pos"), F.col("trimmed_ref"))).where("i IS NOT NULL")
    alt = F.when(F.col("strand") == "+", F.col("trimmed_alt")).otherwise(reverse_complement(F.col("trimmed_alt")))
    edit = F.struct(F.col("i.start").cast("int").alias("cdna_start"), F.col("i.end").cast("int").alias("cdna_end"), alt.alias("alt_bases"), F.col("variant_id").alias("source_variant"))
    return rows.select("variant_id", "transcript_id", "transcript_name", edit.alias("edit"))


def _with_transcripts(proteins: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys, orf and transcript_id of every translation and transcript behind the proteins, each once."""
    rows = proteins.select(*keys, F.explode("translations").alias("t")).select(*keys, "t.orf", F.explode("t.transcripts").alias("x"))
    return rows.select(*keys, "orf", "x.transcript_id").distinct()


def unexplained_edits(proteins: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """(keys, transcript_id, transcript_name, edit): differences of each protein's cDNA from the transcript beside the variant."""
    rows = _with_transcripts(proteins, keys).join(known, ["variant_id", "transcript_id"])
    cdna, begin, end = F.col("orf.cdna_sequence"), F.col("orf.variant_cdna_interval_start"), F.col("orf.variant_cdna_interval_end")
    before, after = F.col("orf.reference_cdna_sequence_before_variant"), F.col("orf.reference_cdna_sequence_after_variant")
    found_before, found_after = F.substring(cdna, F.lit(1), begin), F.substring(cdna, end + 1, F.length(cdna))
    n = F.least(F.length(after), F.length(found_after))
    runs = F.concat(
        edit_runs(before, found_before, F.col("edit.cdna_start") - F.length(before)),
        edit_runs(left_part(after, n), left_part(found_after, n), F.col("edit.cdna_end")),
    )
    found = F.transform(runs, lambda r: F.struct(r["start"].alias("cdna_start"), r["end"].alias("cdna_end"), r["alt"].alias("alt_bases")))
    each = rows.select(*keys, "transcript_id", "transcript_name", F.explode(found).alias("e"))
    edit = F.struct("e.cdna_start", "e.cdna_end", "e.alt_bases", F.lit(None).cast("long").alias("source_variant"))
    return each.select(*keys, "transcript_id", "transcript_name", edit.alias("edit")).distinct()


def protein_edits(proteins: DataFrame, known: DataFrame) -> DataFrame:
    """Edits behind each protein, over all its translations and transcripts, sorted and each once, by category.

    Columns: variant_id, protein_rank, known_somatic, known_germline (always empty),
    unexplained. Edits are structs of transcript, place, bases and source variant.
    """
    keys = ("variant_id", "protein_rank")
    on = F.struct("transcript_id", "edit.cdna_start", "edit.cdna_end", "edit.alt_bases", "edit.source_variant")
    gathered = lambda rows, name: rows.select(*keys, on.alias("e")).groupBy(*keys).agg(F.sort_array(F.collect_set("e")).alias(name))
    somatic = gathered(_with_transcripts(proteins, keys).drop("orf").distinct().join(known, ["variant_id", "transcript_id"]), "known_somatic")
    other = gathered(unexplained_edits(proteins, known, keys), "unexplained")
    rows = proteins.select(*keys).join(somatic, [*keys], "left").join(other, [*keys], "left")
    none = lambda c: F.array().cast(rows.schema[c].dataType)
    listed = lambda c: F.coalesce(c, none(c)).alias(c)
    return rows.select(*keys, listed("known_somatic"), none("known_somatic").alias("known_germline"), listed("unexplained"))


def categorized_edits(known: DataFrame, unexplained: DataFrame) -> DataFrame:
    """All edits with their category: known_somatic or unexplained; there are none of germline variants."""
    return known.withColumn("category", F.lit("known_somatic")).unionByName(unexplained.withColumn("category", F.lit("unexplained")))


def mutant_transcripts(proteins: DataFrame, known: DataFrame, unexplained: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per variant and transcript: cDNA, protein, sorted edits and counts of evidence; the best translation wins."""
    from pyspark.sql.window import Window

    rows = proteins.select("variant_id", "protein_rank", "amino_acids", F.posexplode("translations").alias("n", "t"))
    rows = rows.select("variant_id", "protein_rank", "n", "amino_acids", "t.orf.cdna_sequence", F.explode("t.transcripts").alias("x"))
    first = Window.partitionBy("variant_id", "transcript_id").orderBy("protein_rank", "n")
    rows = rows.withColumn("transcript_id", F.col("x.transcript_id")).withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("x", "rank", "n")
    order = F.struct("edit.cdna_start", "edit.cdna_end", "edit.alt_bases", "edit.source_variant")
    edits = known.unionByName(unexplained).select("variant_id", "transcript_id", order.alias("edit"))
    edits = edits.groupBy("variant_id", "transcript_id").agg(F.sort_array(F.collect_set("edit")).alias("edits"))
    counts = evidence.select("variant_id", "num_alt_reads", "num_alt_fragments")
    return rows.join(edits, ["variant_id", "transcript_id"], "left").join(counts, "variant_id", "left")
