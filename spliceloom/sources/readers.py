"""Readers of variants, alignments and transcripts, and the table sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANT_SCHEMA = "variant_id long, contig string, pos long, ref string, alt string"
TRANSCRIPT_SCHEMA = (
    "transcript_id string, transcript_name string, gene_id string, gene_name string, contig string, strand string, biotype string, "
    "complete boolean, exons array<struct<start:long,end:long>>, sequence string, start_codon_offset int, stop_codon_offset int, protein string"
)


def _numbered(variants: DataFrame) -> DataFrame:
    """Distinct variants with an id that depends on the variant alone."""
    key = F.xxhash64("contig", "pos", "ref", "alt")
    return variants.select(key.alias("variant_id"), "contig", F.col("pos").cast("long").alias("pos"), "ref", "alt").dropDuplicates(["variant_id"])


def vcf_reference(spark: SparkSession, path: str) -> str | None:
    """Reference genome that a VCF file's header names."""
    named = spark.read.text(path).where(F.startswith("value", F.lit("##reference="))).limit(1).collect()
    return named[0].value.partition("=")[2].strip() if named else None


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a VCF file; columns are taken by place, and each alternative allele is a variant."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split("value", "\t")
    alts = F.explode(F.split(F.get(f, F.lit(4)), ","))
    rows = lines.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.upper(F.get(f, F.lit(3))).alias("ref"), alts.alias("alt"))
    return _numbered(rows.withColumn("alt", F.upper("alt")).where("alt rlike '^[ACGTN]+$'"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a MAF file; a dash stands for an empty allele."""
    raw = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    allele = lambda c: F.when(F.col(c) == "-", F.lit("")).otherwise(F.upper(F.col(c)))
    ref, first, second = (allele(c) for c in ("Reference_Allele", "Tumor_Seq_Allele1", "Tumor_Seq_Allele2"))
    alt = F.when(second != ref, second).otherwise(first)
    return _numbered(raw.select(F.col("Chromosome").alias("contig"), F.col("Start_Position").cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt")))


def read_variants_json(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a JSON-lines file with contig, pos, ref and alt."""
    return _numbered(spark.read.schema("contig string, pos long, ref string, alt string").json(path))


def literal_variants(spark: SparkSession, rows: Iterable[tuple[str, int, str, str]]) -> DataFrame:
    """Variants given one by one as (contig, pos, ref, alt)."""
    return _numbered(spark.createDataFrame(list(rows), "contig string, pos long, ref string, alt string"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text file.

    read_ordinal grows in file order, which rules that prefer the first read use.
    """
    lines = spark.read.text(path).withColumn("read_ordinal", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    tags = F.slice(f, 12, 1000)
    md = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit("MD:Z:"))), F.lit(0))
    return lines.where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11)).select(
        "read_ordinal",
        F.when(F.get(f, F.lit(0)) != "*", F.get(f, F.lit(0))).alias("qname"),
        F.get(f, F.lit(1)).try_cast("int").alias("flag"),
        F.get(f, F.lit(2)).alias("rname"),
        F.get(f, F.lit(3)).try_cast("long").alias("pos"),
        F.get(f, F.lit(4)).try_cast("int").alias("mapq"),
        F.get(f, F.lit(5)).alias("cigar"),
        F.upper(F.get(f, F.lit(9))).alias("seq"),
        F.get(f, F.lit(10)).alias("qual"),
        F.substring(md, 6, 1 << 30).alias("md"),
    )


def read_alignments(spark: SparkSession, path: str, loci: DataFrame | None = None) -> DataFrame:
    """Alignments by file name: .sam, .bam, or Parquet with the same columns.

    With ``loci`` (rname, window_start, window_end; see ``locus_windows``) only those parts of BAM files are read whose
    index says that they may hold alignments there. Files of the other kinds are read whole.
    """
    if path.endswith(".cram"):
        raise ValueError("CRAM needs its reference sequences; convert it to BAM or SAM")
    if path.endswith(".bam"):
        from .bam import read_bam, read_bam_at

        if loci is None:
            return read_bam(spark, path)
        return read_bam_at(spark, path, loci.select("rname", F.col("window_start").alias("start"), F.col("window_end").alias("end")))
    return read_sam(spark, path) if path.endswith(".sam") else spark.read.parquet(path)


def read_contigs(spark: SparkSession, path: str) -> DataFrame | None:
    """(rname): contigs that a file's header names; null for files without header."""
    if path.endswith(".bam"):
        from .bam import read_bam

        return read_bam(spark, path, contigs="true").distinct()
    if not path.endswith(".sam"):
        return None
    name = F.regexp_extract("value", "\tSN:([^\t]+)", 1)
    found = spark.read.text(path).where(F.startswith("value", F.lit("@SQ"))).select(name.alias("rname")).distinct()
    return found if found.limit(1).count() else None


def ingest_alignments(alignments: DataFrame, path: str, partitions: int) -> None:
    """Write alignments sorted by place, so that row groups of other loci are skipped when they are read."""
    alignments.repartitionByRange(partitions, "rname", "pos").sortWithinPartitions("rname", "pos", "read_ordinal").write.parquet(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a Parquet or JSON-lines table; see ``TRANSCRIPT_SCHEMA``."""
    reader = spark.read.schema(TRANSCRIPT_SCHEMA)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = True) -> None:
    """Write CSV with a header, of all or the named columns; in one file, or in one of each task for tables of reads."""
    if columns:
        unknown = [c for c in columns if c not in df.columns]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}; there are: {', '.join(df.columns)}")
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)
