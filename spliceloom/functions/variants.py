"""Column functions over variants: trimming and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim_variant(pos: Column, ref: Column, alt: Column) -> Column:
    """Struct (pos, ref, alt) without a shared whole-allele prefix.

    An alt that begins the ref is a deletion of the rest, a ref that begins the
    alt an insertion of the rest behind the last shared base. Partly shared
    prefixes and shared suffixes stay, and so do variants with an empty allele.
    """
    deletion = F.startswith(ref, alt) & (F.length(alt) > 0)
    insertion = F.startswith(alt, ref) & (F.length(ref) > 0)
    new_pos = F.when(deletion, pos + F.length(alt)).when(insertion, pos + F.length(ref) - 1).otherwise(pos)
    new_ref = F.when(deletion, F.substring(ref, F.length(alt) + 1, F.length(ref))).when(insertion, F.lit("")).otherwise(ref)
    new_alt = F.when(deletion, F.lit("")).when(insertion, F.substring(alt, F.length(ref) + 1, F.length(alt))).otherwise(alt)
    same = ref == alt
    return F.struct(
        F.when(same, pos + F.length(ref)).otherwise(new_pos).cast("long").alias("pos"),
        F.when(same, F.lit("")).otherwise(new_ref).alias("ref"),
        F.when(same, F.lit("")).otherwise(new_alt).alias("alt"),
    )


def base0_interval(pos: Column, ref: Column) -> Column:
    """Struct (start, end), half open from 0; an insertion lies between ``pos`` and the next base."""
    insertion = F.length(ref) == 0
    start = F.when(insertion, pos).otherwise(pos - 1)
    return F.struct(start.cast("long").alias("start"), (start + F.length(ref)).cast("long").alias("end"))


def with_trimmed(variants: DataFrame) -> DataFrame:
    """Variants (contig, pos, ref, alt, ...) with trimmed_pos, trimmed_ref, trimmed_alt, locus_start, locus_end."""
    trimmed = variants.withColumn("_t", trim_variant(F.col("pos"), F.col("ref"), F.col("alt")))
    placed = trimmed.withColumn("_i", base0_interval(F.col("_t.pos"), F.col("_t.ref")))
    return placed.withColumns(
        {
            "trimmed_pos": F.col("_t.pos"),
            "trimmed_ref": F.col("_t.ref"),
            "trimmed_alt": F.col("_t.alt"),
            "locus_start": F.col("_i.start"),
            "locus_end": F.col("_i.end"),
        }
    ).drop("_t", "_i")


def short_description(contig: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Genomic description: substitution g.5A>T, insertion g.5_6insT, deletion g.5_6delAC."""
    t = trim_variant(pos, ref, alt)
    name = F.concat(contig, F.lit(" g."))
    n = F.length(t["ref"])
    span = F.when(n == 1, t["pos"].cast("string")).otherwise(F.concat_ws("_", t["pos"], t["pos"] + n - 1))
    return (
        F.when(n == 0, F.concat(name, t["pos"], F.lit("_"), t["pos"] + 1, F.lit("ins"), t["alt"]))
        .when(F.length(t["alt"]) == 0, F.concat(name, span, F.lit("del"), t["ref"]))
        .otherwise(F.concat(name, t["pos"], t["ref"], F.lit(">"), t["alt"]))
    )
