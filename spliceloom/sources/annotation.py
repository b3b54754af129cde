"""Transcripts from a GTF annotation and the genome's FASTA file.

Both are read in splits. A FASTA line does not know where on its contig it lies: tasks
join the lines of their split to chunks and count from the split's or contig's start,
and sums over the few splits and contigs before give the rest. Exons then meet the
chunks they lie on by bins of the axis, and their pieces are spliced in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import is_mitochondrial, slice_text, translate
from ..operators.contexts import spliced_offset
from ..operators.reads import interval_join
from .readers import TRANSCRIPT_SCHEMA

CHUNK = 1 << 16
# Stop codons, and letters with their complements.
STOP_CODONS = ("TAA", "TAG", "TGA")
BASES, COMPLEMENTS = "ACGTRYKMBVDH", "TGCAYRMKVBHD"


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Sequences of a FASTA file as chunks: contig, start and end (half open from 0), bases in upper case.

    A contig's name ends at the first white space. Chunks of a contig are disjoint and cover it; a contig without
    bases has none.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, number, name, offset = None, None, 0, None, 0
        held: list[str] = []
        size = 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal held, size, offset
            text = "".join(held).upper()
            if text or name is not None and offset == 0:
                out.append((file, block, number, name, offset, text))
            offset += len(text)
            held, size = [], 0

        def taken() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["file", "block", "number", "name", "offset", "bases"])
            out.clear()
            return batch

        for batch in batches:
            for line, of_file, of_block in zip(*(c.to_pylist() for c in batch.columns)):
                if (of_file, of_block) != (file, block):
                    flush()
                    file, block, number, name, offset = of_file, of_block, 0, None, 0
                if line.startswith(">"):
                    flush()
                    number, name, offset = number + 1, (line[1:].split() or [""])[0], 0
                elif not line.startswith(";"):
                    held.append(line.strip())
                    size += len(held[-1])
                    if size >= chunk:
                        flush()
            if out:
                yield taken()
        flush()
        if out:
            yield taken()

    pieces = lines.mapInArrow(run, "file string, block long, number long, name string, offset long, bases string")
    runs = pieces.groupBy("file", "block", "number").agg(F.max("name").alias("name"), F.sum(F.length("bases")).alias("length"))
    # A row for each contig and split: what follows an earlier split's contig has no name of its own.
    order = Window.partitionBy("file").orderBy("block", "number")
    runs = runs.withColumn("contig_no", F.count("name").over(order))
    order = Window.partitionBy("file", "contig_no").orderBy("block", "number")
    runs = runs.withColumns(
        {"contig": F.first("name").over(order), "before": F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    ).where("contig IS NOT NULL")
    start = F.col("before") + F.col("offset")
    joined = pieces.where("bases <> ''").join(runs.select("file", "block", "number", "contig", "before"), ["file", "block", "number"])
    return joined.select("contig", start.alias("start"), (start + F.length("bases")).alias("end"), "bases")


def _attribute(*names: str) -> Column:
    """The value of the first of the attributes that a GTF line has."""
    found = [F.regexp_extract("attributes", f'(?:^|; *){n} "([^"]*)"', 1) for n in names]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Exons, coding parts and codons of a GTF file: one row for each, positions from 1, ends included."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 9))
    rows = lines.select(
        at(0).alias("contig"), at(1).alias("source"), at(2).alias("feature"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end"),
        at(6).alias("strand"), at(7).try_cast("int").alias("frame"), at(8).alias("attributes"),
    )
    rows = rows.where(F.col("feature").isin("exon", "CDS", "start_codon", "stop_codon"))
    rows = rows.withColumns(
        {
            "transcript_id": _attribute("transcript_id"),
            "transcript_name": _attribute("transcript_name"),
            "gene_id": _attribute("gene_id"),
            "gene_name": _attribute("gene_name", "gene"),
            "biotype": F.coalesce(_attribute("transcript_biotype", "transcript_type", "gene_biotype", "gene_type"), F.col("source")),
            "cut_start": F.contains("attributes", F.lit('"cds_start_NF"')),
            "cut_end": F.contains("attributes", F.lit('"cds_end_NF"')),
        }
    )
    return rows.where("transcript_id IS NOT NULL").drop("attributes", "source")


def _models(parts: DataFrame) -> DataFrame:
    """A row for each transcript: exons in its own direction, and where its first and last codons begin on the genome."""
    of = lambda feature, c: F.when(F.col("feature") == feature, F.col(c))
    forward = F.col("strand") == "+"
    span = F.struct("start", "end")
    ends = {f"{k}_{side}": f(of(name, side)) for k, name in (("cds", "CDS"), ("first", "start_codon"), ("last", "stop_codon")) for side, f in (("start", F.min), ("end", F.max))}
    grouped = parts.groupBy("transcript_id", "contig", "strand").agg(
        *[F.max(c).alias(c) for c in ("transcript_name", "gene_id", "gene_name", "biotype", "cut_start", "cut_end")],
        F.sort_array(F.collect_set(F.when(F.col("feature") == "exon", span))).alias("exons"),
        *[c.alias(k) for k, c in ends.items()],
        F.min_by(of("CDS", "frame"), of("CDS", "start")).alias("frame_left"),
        F.max_by(of("CDS", "frame"), of("CDS", "end")).alias("frame_right"),
    )
    first_side = lambda k: F.when(forward, F.col(f"{k}_start")).otherwise(F.col(f"{k}_end"))
    last_side = lambda k: F.when(forward, F.col(f"{k}_end")).otherwise(F.col(f"{k}_start"))
    return grouped.where(F.size("exons") > 0).select(
        "transcript_id", "transcript_name", "gene_id", "gene_name", "contig", "strand", "biotype", "cut_start", "cut_end",
        F.when(forward, F.col("exons")).otherwise(F.reverse("exons")).alias("exons"),
        first_side("first").alias("start_codon"),
        first_side("last").alias("stop_codon"),
        F.when(F.coalesce(F.when(forward, F.col("frame_left")).otherwise(F.col("frame_right")), F.lit(0)) == 0, first_side("cds")).alias("coding_first"),
        last_side("cds").alias("coding_last"),
    )


def transcripts_from(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Transcripts (see ``TRANSCRIPT_SCHEMA``) from the rows of ``read_gtf`` and the chunks of ``read_fasta``.

    The first codon is where the start_codon rows begin; without such rows it is the coding part's start, if its frame
    is 0 and it reads ATG. The last one is where the stop_codon rows begin; without them, a stop codon behind the coding
    part or at its end. Tags that call an end of the coding part unknown leave that codon out. A transcript is complete
    if it has both and whole codons between. Contigs agree up to case and a leading chr; a transcript whose contig is
    missing or ends too early has no sequence.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "(?i)^chr", ""))
    models = _models(parts)
    exons = models.select("transcript_id", "contig", F.explode("exons").alias("e")).select(
        "transcript_id", "contig", plain(F.col("contig")).alias("place"), (F.col("e.start") - 1).alias("exon_start"), F.col("e.end").alias("exon_end")
    )
    laid = chunks.select(plain(F.col("contig")).alias("chunk_place"), F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"), "bases")
    met = interval_join(laid, exons, ("chunk_place", "chunk_start", "chunk_end"), ("place", "exon_start", "exon_end"), CHUNK)
    begin = F.greatest("exon_start", "chunk_start")
    piece = slice_text(F.col("bases"), begin - F.col("chunk_start"), F.least("exon_end", "chunk_end") - F.col("chunk_start"))
    pieces = met.select("transcript_id", "contig", F.struct(begin.alias("at"), piece.alias("text")).alias("piece"))
    spliced = pieces.groupBy("transcript_id", "contig").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["text"]), "").alias("forward"))

    rows = models.join(spliced, ["transcript_id", "contig"], "left")
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda s, e: s + e["end"] - e["start"] + 1)
    forward = F.when(F.length("forward") == length, F.col("forward"))
    rows = rows.withColumn("sequence", F.when(F.col("strand") == "+", forward).otherwise(F.reverse(F.translate(forward, BASES, COMPLEMENTS))))
    offset = lambda c: spliced_offset(F.col("exons"), F.col("strand"), F.col(c))
    rows = rows.withColumns({c: offset(c) for c in ("start_codon", "stop_codon", "coding_first", "coding_last")})
    codon = lambda at: slice_text(F.col("sequence"), at, at + 3)
    first, behind = F.col("coding_first"), F.col("coding_last") + 1
    start = F.coalesce(F.col("start_codon"), F.when(codon(first) == "ATG", first))
    stop = F.coalesce(F.col("stop_codon"), F.when(codon(behind).isin(*STOP_CODONS), behind), F.when(codon(behind - 3).isin(*STOP_CODONS), behind - 3))
    rows = rows.withColumns({"start_codon_offset": F.when(~F.col("cut_start"), start).cast("int"), "stop_codon_offset": F.when(~F.col("cut_end"), stop).cast("int")})
    first, last = F.col("start_codon_offset"), F.col("stop_codon_offset")
    coding = F.when((last > first) & F.col("sequence").isNotNull(), slice_text(F.col("sequence"), first, last))
    rows = rows.withColumns(
        {
            "complete": F.coalesce((last > first) & ((last - first) % 3 == 0) & F.col("sequence").isNotNull(), F.lit(False)),
            "protein": F.when(coding.isNotNull(), translate(coding, is_mitochondrial(F.col("contig")), F.lit(True))["amino_acids"]),
        }
    )
    return rows.select(*[c.split()[0] for c in TRANSCRIPT_SCHEMA.split(", ")])


def read_annotation(spark: SparkSession, gtf: str, fasta: str) -> DataFrame:
    """Transcripts of a GTF file with sequences from the genome in a FASTA file."""
    return transcripts_from(read_gtf(spark, gtf), read_fasta(spark, fasta))
