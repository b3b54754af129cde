"""From variants and alignments to reads at each locus and their alleles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar as C
from ..functions.dna import after_last_n, before_first_n, slice_text
from ..functions.indels import left_aligned_interval
from ..functions.variants import with_trimmed
from ..plans.scratch import stage_table
from .mates import merge_mates


@dataclass(frozen=True)
class ReadOptions:
    """Which alignments count as reads, and how they are cut."""

    min_mapping_quality: int = 1
    use_duplicates: bool = False
    use_secondary: bool = True
    use_soft_clipped: bool = False
    merge_overlapping_mates: bool = False
    bin_size: int = 4096


SECONDARY, DUPLICATE, UNMAPPED = 256, 1024, 4
#: As many loci are sent to the reads instead of meeting them by bins.
FEW_LOCI = 65536


def usable_alignments(alignments: DataFrame, options: ReadOptions = ReadOptions()) -> DataFrame:
    """Alignments that can be reads. Supplementary and QC-failed ones stay."""
    flag = F.col("flag")
    ok = F.col("qname").isNotNull() & (flag.bitwiseAND(F.lit(UNMAPPED)) == 0)
    ok &= F.coalesce("mapq", F.lit(0)) >= options.min_mapping_quality
    if not options.use_secondary:
        ok &= flag.bitwiseAND(F.lit(SECONDARY)) == 0
    if not options.use_duplicates:
        ok &= flag.bitwiseAND(F.lit(DUPLICATE)) == 0
    ok &= (F.col("seq") != "*") & (F.col("qual") != "*") & (F.length("seq") == F.length("qual"))
    ok &= C.read_length("cigar") == F.length("seq")
    return alignments.where(ok)


def reconcile_contigs(variants: DataFrame, alignments: DataFrame) -> DataFrame:
    """Variants with ``rname``, their contig's name among the alignments, or in a table of contigs with that column.

    Names agree up to case and a leading chr; the same name is preferred, then
    the first in order. Variants on contigs without alignments have none.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "(?i)^chr", ""))
    names = alignments.select("rname").where("rname <> '*'").distinct()
    contigs = variants.select("contig").distinct()
    pairs = contigs.join(names, plain(contigs["contig"]) == plain(names["rname"]))
    best = pairs.groupBy("contig").agg(F.min(F.struct((F.col("rname") != F.col("contig")).alias("other"), "rname")).alias("b"))
    return variants.join(best.select("contig", F.col("b.rname").alias("rname")), "contig", "left")


def interval_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str], right_on: tuple[str, str, str], bin_size: int) -> DataFrame:
    """Pairs whose half-open intervals (key, start, end) of whole numbers overlap, each once.

    Left intervals are sent once, so the larger side belongs there: each to the bin of its start, in bins of the least
    doubling of ``bin_size`` that is as wide as the interval. For every such width that occurs, the right ones go to the
    bins that they meet and the one before, where intervals that reach them start.
    """
    (lk, ls, le), (rk, rs, re) = left_on, right_on
    over = F.floor((F.col(le) - F.col(ls) - 1) / bin_size)
    a = left.where(F.col(le) > F.col(ls)).withColumn("_doublings", F.when(over == 0, 0).otherwise(F.length(F.bin(over))))
    place = lambda x, n: F.floor(x / (bin_size * F.pow(F.lit(2.0), n)))
    # Bins of all widths are one number; no more than 63 widths come here.
    bin_of = lambda at, n: at * 64 + n
    widths = [r[0] for r in a.select("_doublings").distinct().collect()]
    a = a.withColumn("_bin", bin_of(place(F.col(ls), F.col("_doublings")), F.col("_doublings"))).drop("_doublings")
    met = lambda n: F.transform(F.sequence(place(F.col(rs), F.lit(n)) - 1, place(F.col(re) - 1, F.lit(n))), lambda x: bin_of(x, n))
    b = right.where(F.col(re) > F.col(rs)).withColumn("_rbin", F.explode(F.concat(F.array().cast("array<bigint>"), *map(met, widths))))
    meet = (F.col(lk) == F.col(rk)) & (F.col("_bin") == F.col("_rbin")) & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    return a.join(b, meet).drop("_bin", "_rbin")


def locus_windows(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """Variants (trimmed) by contig of the alignments, with their locus widened by one base on either side.

    ``contigs`` has the alignments' contigs as ``rname``. Columns: variant_id, rname, trimmed_pos, trimmed_ref,
    trimmed_alt, locus_start, locus_end, window_start, window_end (half open from 0).
    """
    loci = reconcile_contigs(with_trimmed(variants), contigs).where("rname IS NOT NULL")
    return loci.select(
        "variant_id",
        "rname",
        "trimmed_pos",
        "trimmed_ref",
        "trimmed_alt",
        "locus_start",
        "locus_end",
        F.greatest(F.lit(0), F.col("locus_start") - 1).alias("window_start"),
        (F.col("locus_end") + 1).alias("window_end"),
    )


def alignments_near_loci(
    variants: DataFrame, alignments: DataFrame, options: ReadOptions = ReadOptions(), contigs: DataFrame | None = None
) -> DataFrame:
    """Usable alignments with ``blocks`` and ``loci``, the list of ``locus_windows`` that an aligned base of theirs lies in.

    Bins come from the aligned blocks, so a read spliced over a locus does not meet it. A locus is listed once, at the
    read's first block and bin that meet it; reads without any are left out. Up to ``FEW_LOCI`` loci go to the reads, which
    then stay where they are however many lie on one locus; more of them meet the reads by contig and bin. ``contigs``
    (rname), as a file's header has them, spare a pass over the alignments.
    """
    windows = stage_table(locus_windows(variants, alignments if contigs is None else contigs), "locus-windows")
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / options.bin_size), F.floor((e - 1) / options.bin_size)))
    window = F.struct(*[c for c in windows.columns if c != "rname"])
    binned = windows.select(F.col("rname").alias("locus_rname"), bins(F.col("window_start"), F.col("window_end")).alias("locus_bin"), window.alias("w"))
    near = binned.groupBy("locus_rname", "locus_bin").agg(F.collect_list("w").alias("near"))
    if windows.limit(FEW_LOCI + 1).count() <= FEW_LOCI:
        near = F.broadcast(near)
    reads = usable_alignments(alignments, options).withColumn("blocks", C.aligned_blocks("cigar", "pos"))
    parts = reads.select("*", F.posexplode("blocks").alias("block_no", "b")).where("b.len > 0")
    start, end = F.col("b.ref"), F.col("b.ref") + F.col("b.len")
    met = parts.withColumn("block_bin", bins(start, end)).join(near, (F.col("rname") == F.col("locus_rname")) & (F.col("block_bin") == F.col("locus_bin")))

    def here(w: Column) -> Column:
        overlap = (w["window_start"] < end) & (start < w["window_end"]) & (F.floor(F.greatest(w["window_start"], start) / options.bin_size) == F.col("block_bin"))
        return overlap & (C.first_overlap(F.col("blocks"), w["window_start"], w["window_end"]) == F.col("block_no"))

    # Behind a generator: the filter on the list then doesn't compute it again.
    listed = met.withColumn("loci", F.explode(F.array(F.filter("near", here)))).where(F.size("loci") > 0)
    return listed.drop("block_no", "b", "block_bin", "locus_rname", "locus_bin", "near")


def overlapping_alignments(
    variants: DataFrame, alignments: DataFrame, options: ReadOptions = ReadOptions(), contigs: DataFrame | None = None
) -> DataFrame:
    """Alignments with an aligned base in each variant's locus, widened by one base on either side; see ``alignments_near_loci``."""
    met = alignments_near_loci(variants, alignments, options, contigs)
    return met.withColumn("w", F.explode("loci")).select(*[c for c in met.columns if c != "loci"], "w.*")


def locus_reads(
    variants: DataFrame, alignments: DataFrame, options: ReadOptions = ReadOptions(), contigs: DataFrame | None = None
) -> DataFrame:
    """Reads at each locus with the locus' interval on the read.

    Columns: variant_id, read_ordinal, name, sequence, reference_positions,
    quality_scores, source_read_count, reference_base0_start/end,
    read_base0_start/end.
    """
    near = alignments_near_loci(variants, alignments, options, contigs)
    length = F.length("seq").cast("long")
    first, last = C.clipped_start(F.col("cigar")), length - C.clipped_end(F.col("cigar"))
    # What a read has at every locus is laid out before its loci are.
    laid_out = near.withColumns(
        {
            "positions": C.reference_positions(F.col("blocks"), length),
            "scores": F.transform(F.split("qual", ""), lambda q: F.ascii(q) - 33),
            "clips": F.struct(first.alias("first"), last.alias("last")),
        }
    )
    met = laid_out.withColumn("w", F.explode("loci")).select(*[c for c in laid_out.columns if c != "loci"], "w.*")
    pure_indel = (F.length("trimmed_ref") == 0) != (F.length("trimmed_alt") == 0)
    shiftable = pure_indel & F.col("md").isNotNull() & F.col("cigar").rlike("[ID]")
    columns = map(F.col, ("seq", "cigar", "md", "blocks", "trimmed_pos", "trimmed_ref", "trimmed_alt"))
    # A list of one or no interval, behind a generator: filters on the interval then don't compute it again.
    rows = met.withColumn("shifted", F.explode(F.array(F.when(shiftable, left_aligned_interval(*columns)))))

    blocks, start, end = F.col("blocks"), F.col("locus_start"), F.col("locus_end")
    before, after = C.read_offset(blocks, start - 1), C.read_offset(blocks, start)
    insertion = F.length("trimmed_ref") == 0
    ins_start = F.when(before.isNull() & after.isNull(), F.lit(None)).when(before.isNull(), F.col("clips.first")).otherwise(before + 1)
    ins_end = F.when(before.isNull() & after.isNull(), F.lit(None)).when(after.isNull(), F.col("clips.last")).otherwise(after)
    sub_start = F.coalesce(after, before + 1)
    sub_end = F.coalesce(C.read_offset(blocks, end), C.read_offset(blocks, end - 1) + 1)
    interval = F.struct(
        F.coalesce(F.col("shifted.start"), F.when(insertion, ins_start).otherwise(sub_start)).alias("a"),
        F.coalesce(F.col("shifted.end"), F.when(insertion, ins_end).otherwise(sub_end)).alias("z"),
    )
    rows = rows.withColumn("interval", F.explode(F.array(interval))).withColumns(
        {
            "a": F.col("interval.a"),
            "z": F.col("interval.z"),
            "first": F.lit(0).cast("long") if options.use_soft_clipped else F.col("clips.first"),
            "last": length if options.use_soft_clipped else F.col("clips.last"),
        }
    ).where("a IS NOT NULL AND z IS NOT NULL")
    cut = lambda c: F.slice(c, (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int"))
    reads = rows.select(
        "variant_id",
        "read_ordinal",
        F.col("qname").alias("name"),
        slice_text(F.col("seq"), F.col("first"), F.col("last")).alias("sequence"),
        cut(F.col("positions")).alias("reference_positions"),
        cut(F.col("scores")).alias("quality_scores"),
        F.lit(1).cast("long").alias("source_read_count"),
        start.alias("reference_base0_start"),
        end.alias("reference_base0_end"),
        (F.col("a") - F.col("first")).alias("read_base0_start"),
        (F.col("z") - F.col("first")).alias("read_base0_end"),
    ).where("read_base0_start >= 0 AND read_base0_end >= read_base0_start AND read_base0_end <= length(sequence)")
    return merge_mates(reads) if options.merge_overlapping_mates else reads


def reads_at_locus(
    alignments: DataFrame, contig: str, start: int, end: int, options: ReadOptions = ReadOptions(), contigs: DataFrame | None = None
) -> DataFrame:
    """``locus_reads`` of a place without any variant: from ``start`` to before ``end``, from 0; between two bases if they are equal.

    variant_id is contig:start-end.
    """
    if not 0 <= start <= end:
        raise ValueError(f"no such interval: {start}-{end}")
    # Letters that no read has: nothing is trimmed, and no indel is shifted to them.
    row = (f"{contig}:{start}-{end}", contig, start + 1 if end > start else start, "?" * (end - start), "!" * max(end - start, 1))
    locus = alignments.sparkSession.createDataFrame([row], "variant_id string, contig string, pos long, ref string, alt string")
    return locus_reads(locus, alignments, options, contigs)


def allele_reads(reads: DataFrame) -> DataFrame:
    """Locus reads as prefix, allele and suffix; those with an N in the allele go, and N ends prefix and suffix."""
    seq, a, z = F.col("sequence"), F.col("read_base0_start"), F.col("read_base0_end")
    parts = reads.select(
        "variant_id",
        "read_ordinal",
        after_last_n(slice_text(seq, F.lit(0), a)).alias("prefix"),
        slice_text(seq, a, z).alias("allele"),
        before_first_n(slice_text(seq, z, F.length(seq))).alias("suffix"),
        "name",
        "source_read_count",
    ).where(~F.contains("allele", F.lit("N")))
    return parts.withColumn("sequence", F.concat("prefix", "allele", "suffix"))


def classify(reads: DataFrame, ref: Column, alt: Column) -> Column:
    """ref, alt or other, by exact equality of the allele."""
    return F.when(reads["allele"] == ref, "ref").when(reads["allele"] == alt, "alt").otherwise("other")


def read_evidence(variants: DataFrame, reads: DataFrame) -> DataFrame:
    """Allele reads in long form with ``allele_class``, trimmed_ref and trimmed_alt of their variant."""
    alleles = with_trimmed(variants).select("variant_id", "trimmed_pos", "trimmed_ref", "trimmed_alt")
    joined = reads.join(alleles, "variant_id")
    return joined.withColumn("allele_class", classify(joined, F.col("trimmed_ref"), F.col("trimmed_alt")))


def base_counts_by_position(reads: DataFrame) -> DataFrame:
    """Bases seen at each reference position of a locus' reads, one column per base."""
    zipped = F.explode(F.arrays_zip(F.col("reference_positions").alias("pos"), F.split("sequence", "").alias("base")))
    seen = reads.select("variant_id", zipped.alias("z")).select("variant_id", "z.pos", "z.base").where("pos IS NOT NULL")
    return seen.groupBy("variant_id", "pos").agg(*[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"])


def modal_allele(reads: DataFrame) -> DataFrame:
    """Reads of each variant's most common allele; of equally common ones, the allele seen first."""
    counted = reads.groupBy("variant_id", "allele").agg(F.count("*").alias("n"), F.min("read_ordinal").alias("seen"))
    order = Window.partitionBy("variant_id").orderBy(F.desc("n"), "seen")
    top = counted.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("variant_id", "allele")
    return reads.join(top, ["variant_id", "allele"], "left_semi")
