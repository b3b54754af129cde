"""Commands: ``python -m spliceloom.cli COMMAND --vcf FILE --bam FILE --transcripts TABLE --output FOLDER``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .operators import results as R
from .operators.proteins import ProteinOptions
from .operators.reads import ReadOptions, locus_windows
from .plans.pipeline import Options, Run
from .plans.scratch import stage_table
from .sources import readers
from .sources.annotation import read_annotation

COMMANDS = {
    "results": lambda r: R.flattened(r.results()),
    "protein-sequences": lambda r: R.protein_sequences_frame(r.proteins, r.variants),
    "translations": lambda r: R.translations_frame(r.translations, r.variants),
    "reference-contexts": lambda r: R.reference_contexts_frame(r.contexts, r.variants),
    "allele-reads": lambda r: R.allele_reads_frame(r.evidence, r.variants, r.transcripts),
    "allele-counts": lambda r: R.allele_counts_frame(r.counts, r.variants),
    "variant-reads": lambda r: R.allele_reads_frame(r.alt_reads, r.variants, r.transcripts),
    "variant-sequences": lambda r: R.variant_sequences_frame(r.sequences, r.variants, r.transcripts),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spliceloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--vcf", nargs="*", default=[])
    p.add_argument("--maf", nargs="*", default=[])
    p.add_argument("--json-variants", nargs="*", default=[])
    p.add_argument("--variant", nargs=4, action="append", default=[], metavar=("CONTIG", "POS", "REF", "ALT"))
    p.add_argument("--bam", help="a BAM or SAM file, or a Parquet folder of alignments")
    p.add_argument("--transcripts", help="a table of transcripts; {reference} in its name or in those of annotation files is the reference genome")
    p.add_argument("--gtf", help="annotation from which transcripts are made, with --fasta, the genome's sequence")
    p.add_argument("--fasta")
    p.add_argument("--genome", help="name of the reference genome; by default the one in the headers of the VCF files")
    p.add_argument("--output", help="folder of the CSV; by default spliceloom-COMMAND.csv")
    p.add_argument("--output-columns", nargs="*")
    p.add_argument("--min-mapping-quality", type=int, default=1)
    p.add_argument("--use-duplicate-reads", action="store_true")
    p.add_argument("--drop-secondary-alignments", action="store_true")
    p.add_argument("--use-soft-clipped-bases", action="store_true")
    p.add_argument("--merge-overlapping-mates", action="store_true")
    p.add_argument("--min-variant-sequence-coverage", type=int, default=2)
    p.add_argument("--disable-variant-sequence-assembly", action="store_true")
    p.add_argument("--min-assembly-overlap", type=int, default=30)
    p.add_argument("--protein-sequence-length", type=int, default=20)
    p.add_argument("--max-protein-sequences-per-variant", type=int, default=1)
    p.add_argument("--min-transcript-prefix-length", type=int, default=10)
    p.add_argument("--max-reference-transcript-mismatches", type=int, default=2)
    p.add_argument("--count-mismatches-after-variant", action="store_true")
    p.add_argument("--reference-context-size", "--context-size", type=int, default=30)
    p.add_argument("--variant-sequence-length", type=int, default=90, help="nucleotides of a sequence (variant-sequences only)")
    limits = {"num-alt-reads": ("alt-rna-reads", int, 3), "num-alt-fragments": ("alt-rna-fragments", int, 2), "fraction-alt-fragments": ("alt-rna-fraction", float, 0.005)}
    for name, (short, kind, value) in limits.items():
        p.add_argument(f"--min-{short}", f"--min-{name}", dest=f"min_{name.replace('-', '_')}", type=kind, default=value)
    p.add_argument("--min-ratio-alt-to-other-fragments", type=float, default=3.0)
    return p


def options_of(a: argparse.Namespace) -> Options:
    base = Options.command_line()
    return replace(
        base,
        reads=ReadOptions(a.min_mapping_quality, a.use_duplicate_reads, not a.drop_secondary_alignments, a.use_soft_clipped_bases, a.merge_overlapping_mates),
        proteins=ProteinOptions(
            a.protein_sequence_length,
            a.max_protein_sequences_per_variant,
            a.min_transcript_prefix_length,
            a.max_reference_transcript_mismatches,
            a.count_mismatches_after_variant,
        ),
        coverage=a.min_variant_sequence_coverage,
        assembly=not a.disable_variant_sequence_assembly,
        min_overlap=a.min_assembly_overlap,
        thresholds={k: getattr(a, k) for k in base.thresholds},
        context_size=a.reference_context_size if a.command == "reference-contexts" else None,
        sequence_length=a.variant_sequence_length if a.command == "variant-sequences" else None,
    )


def variants_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = [readers.read_vcf(spark, p) for p in a.vcf] + [readers.read_maf(spark, p) for p in a.maf]
    found += [readers.read_variants_json(spark, p) for p in a.json_variants]
    if a.variant:
        found.append(readers.literal_variants(spark, [(c, int(p), r, t) for c, p, r, t in a.variant]))
    if not found:
        raise SystemExit("no variants given")
    return reduce(DataFrame.unionByName, found).dropDuplicates(["variant_id"])


def reference_of(spark: SparkSession, a: argparse.Namespace) -> str:
    """The reference genome's name: the one given, or the one that all VCF files with such a header line name."""
    named = [a.genome] if a.genome else sorted({n for p in a.vcf if (n := readers.vcf_reference(spark, p))})
    if len(named) != 1:
        raise SystemExit(f"one reference genome is needed for {{reference}}, there are: {', '.join(named) or 'none'}")
    return named[0]


def transcripts_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    paths = (a.transcripts, a.gtf, a.fasta)
    if any("{reference}" in (p or "") for p in paths):
        paths = tuple(p and p.replace("{reference}", reference_of(spark, a)) for p in paths)
    table, gtf, fasta = paths
    if table:
        return readers.read_transcripts(spark, table)
    if gtf and fasta:
        return stage_table(read_annotation(spark, gtf, fasta), "transcripts")
    return None


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("spliceloom").getOrCreate()
    variants, alignments, contigs = variants_of(spark, a), None, None
    if a.bam:
        contigs = readers.read_contigs(spark, a.bam)
        alignments = readers.read_alignments(spark, a.bam, locus_windows(variants, contigs) if contigs is not None else None)
    run = Run(variants, alignments, transcripts_of(spark, a), options_of(a), contigs)
    # Tables of reads, sequences and translations are too large for one task.
    whole = a.command not in ("allele-reads", "variant-reads", "variant-sequences", "translations")
    readers.write_table(COMMANDS[a.command](run), a.output or f"spliceloom-{a.command}.csv", a.output_columns, whole)


if __name__ == "__main__":
    main()
