"""Reference transcripts around a variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import frame_to_offset, is_mitochondrial, reverse_complement, slice_text
from ..functions.variants import with_trimmed

KEY = (
    "strand",
    "sequence_before_variant_locus",
    "sequence_at_variant_locus",
    "sequence_after_variant_locus",
    "offset_to_first_complete_codon",
    "contains_start_codon",
    "overlaps_start_codon",
    "contains_five_prime_utr",
    "amino_acids_before_variant",
)


def spliced_offset(exons: Column, strand: Column, position: Column) -> Column:
    """Place on the transcript, from 0, of a genomic position from 1; null between exons. Exon ends count in."""
    inside = lambda e: (e["start"] <= position) & (position <= e["end"])
    exon = F.get(F.filter(exons, inside), F.lit(0))
    earlier = F.when(strand == "+", F.filter(exons, lambda e: e["end"] < position)).otherwise(F.filter(exons, lambda e: e["start"] > position))
    before = F.aggregate(earlier, F.lit(0).cast("long"), lambda s, e: s + e["end"] - e["start"] + 1)
    within = F.when(strand == "+", position - exon["start"]).otherwise(exon["end"] - position)
    return F.when(exon.isNotNull(), before + within)


def interval_on_transcript(exons: Column, strand: Column, pos: Column, ref: Column) -> Column:
    """Struct (start, end) of a trimmed variant on the transcript, half open from 0; null off the exons."""
    forward = strand == "+"
    at = spliced_offset(exons, strand, pos)
    point = F.when(forward, at + 1).otherwise(at)
    # Exons clipped to the variant: their outermost bases are the first and the last on the transcript.
    last = pos + F.greatest(F.length(ref) - 1, F.lit(0))
    met = F.filter(exons, lambda e: (e["start"] <= last) & (e["end"] >= pos))
    ends = F.struct(
        F.array_min(F.transform(met, lambda e: F.greatest(e["start"], pos))).alias("low"), F.array_max(F.transform(met, lambda e: F.least(e["end"], last))).alias("high")
    )

    def span(e: Column) -> Column:
        low, high = spliced_offset(exons, strand, e["low"]), spliced_offset(exons, strand, e["high"])
        return F.struct(F.when(forward, low).otherwise(high).alias("start"), (F.when(forward, high).otherwise(low) + 1).alias("end"))

    # Bound to a name, so that the ends are found once and not for every exon.
    replaced = F.get(F.transform(F.array(ends), span), F.lit(0))
    start = F.when(F.length(ref) == 0, point).otherwise(replaced["start"])
    end = F.when(F.length(ref) == 0, point).otherwise(replaced["end"])
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def overlapping_transcripts(variants: DataFrame, transcripts: DataFrame, bin_size: int = 1 << 17) -> DataFrame:
    """Variants (trimmed) with every transcript whose span holds the locus, introns included."""
    plain = lambda c: F.lower(F.regexp_replace(c, "(?i)^chr", ""))
    spans = transcripts.withColumns(
        {
            "t_contig": plain(F.col("contig")),
            "t_start": F.array_min(F.transform("exons", lambda e: e["start"])),
            "t_end": F.array_max(F.transform("exons", lambda e: e["end"])) + 1,
        }
    ).drop("contig")
    loci = with_trimmed(variants).withColumns({"v_contig": plain(F.col("contig")), "v_bin": F.floor(F.col("trimmed_pos") / bin_size)})
    spans = spans.withColumn("v_bin", F.explode(F.sequence(F.floor(F.col("t_start") / bin_size), F.floor(F.col("t_end") / bin_size))))
    last = F.col("trimmed_pos") + F.greatest(F.length("trimmed_ref") - 1, F.lit(0))
    meet = (F.col("v_contig") == F.col("t_contig")) & (loci["v_bin"] == spans["v_bin"]) & (F.col("trimmed_pos") < F.col("t_end")) & (last >= F.col("t_start"))
    return loci.join(spans, meet).drop("v_contig", "v_bin", "t_contig", "t_start", "t_end")


def reference_contexts(variants: DataFrame, transcripts: DataFrame, context_size: int, whitelist: list[str] | None = None) -> DataFrame:
    """Coding contexts of each variant; transcripts with equal ones are gathered.

    Columns: variant_id, the key columns, transcripts (structs by id), mitochondrial,
    max_cds, context_rank (longest coding sequence first). A transcript counts if
    it has a start codon, a stop codon and a protein, its sequence has 6
    nucleotides and agrees with the variant's reference allele, and the variant
    lies behind the start codon and before the 3' UTR.
    """
    if whitelist is not None:
        transcripts = transcripts.where(F.col("transcript_id").isin(whitelist))
    usable = transcripts.where("start_codon_offset IS NOT NULL AND stop_codon_offset IS NOT NULL AND length(protein) > 0 AND length(sequence) >= 6")
    rows = overlapping_transcripts(variants, usable)
    # A list of one or no interval is exploded: filters on the interval then don't compute it again.
    interval = interval_on_transcript(F.col("exons"), F.col("strand"), F.col("trimmed_pos"), F.col("trimmed_ref"))
    rows = rows.withColumn("i", F.explode(F.filter(F.array(interval), lambda i: i.isNotNull())))
    start, end, seq = F.col("i.start"), F.col("i.end"), F.col("sequence")
    expected = F.when(F.col("strand") == "+", F.col("trimmed_ref")).otherwise(reverse_complement(F.col("trimmed_ref")))
    first, stop = F.col("start_codon_offset"), F.col("stop_codon_offset")
    rows = rows.where((slice_text(seq, start, end) == expected) & (start >= first + 3) & (start < stop + 3))
    rows = rows.withColumn("before", slice_text(seq, start - context_size, start))
    rows = rows.withColumns({"n": F.length("before"), "distance": start - first, "codons": F.floor((start - first) / 3)})
    n, distance, codons = F.col("n"), F.col("distance"), F.col("codons")
    whole = n >= distance
    skip = F.when(whole, first - start + n).otherwise(frame_to_offset(F.pmod(start - n - first, F.lit(3))))
    rows = rows.withColumn("skip", skip.cast("int"))
    rows = rows.withColumn("in_prefix", F.when(whole, codons).otherwise(F.floor((n - F.col("skip")) / 3)))
    keyed = rows.select(
        "variant_id",
        "contig",
        "strand",
        F.col("before").alias("sequence_before_variant_locus"),
        slice_text(seq, start, end).alias("sequence_at_variant_locus"),
        slice_text(seq, end, end + context_size).alias("sequence_after_variant_locus"),
        F.col("skip").alias("offset_to_first_complete_codon"),
        whole.alias("contains_start_codon"),
        (n > distance - 3).alias("overlaps_start_codon"),
        (n > distance).alias("contains_five_prime_utr"),
        slice_text(F.col("protein"), codons - F.col("in_prefix"), codons).alias("amino_acids_before_variant"),
        F.struct("transcript_id", "transcript_name", "gene_id", "gene_name").alias("transcript"),
        (stop + 3 - first).alias("cds"),
    )
    grouped = keyed.groupBy("variant_id", *KEY).agg(
        F.sort_array(F.collect_set("transcript")).alias("transcripts"), F.max("cds").alias("max_cds"), F.first(is_mitochondrial(F.col("contig"))).alias("mitochondrial")
    )
    order = Window.partitionBy("variant_id").orderBy(F.desc("max_cds"), F.col("transcripts")[0]["transcript_id"], *KEY)
    return grouped.withColumn("context_rank", F.row_number().over(order))
