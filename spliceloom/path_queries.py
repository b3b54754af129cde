"""Registered queries over the path from alignments and transcripts to results, and the same in DuckDB SQL.

Inputs are laid out over the driver's tables: nucleotides of whole documents become reads and transcripts, line items
become counts, translations and effects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import assembly, contexts, effects, evidence, filters, proteins, reads, results
from .plans.scratch import stage_table
from .queries import _dna, _evidence, _letters, _table, _translated

# Alignments: one per document, of all its A, C, G, T and N. Clips, gaps, flags and qualities depend on the id.
CIGAR = """CASE WHEN doc_id % 19 = 0 THEN (n + 1) || 'M' WHEN doc_id % 6 = 0 THEN n || 'M' WHEN doc_id % 6 = 1 THEN '3S' || (n - 3) || 'M'
    WHEN doc_id % 6 = 2 THEN (n - 4) || 'M4S' WHEN doc_id % 6 = 3 THEN h || 'M5D' || (n - h) || 'M'
    WHEN doc_id % 6 = 4 THEN h || 'M2I' || (n - h - 2) || 'M' ELSE h || 'M50N' || (n - h) || 'M' END"""
FLAG = "CASE doc_id % 11 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 1024 ELSE doc_id % 2 * 16 END"
KINDS = (("A", "C"), ("AC", "A"), ("A", "AG"))
PLACES = tuple(range(9, 130, 10))


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", _letters("ACGTN").alias("seq")).where("length(seq) >= 40 AND lang IS NOT NULL")
    rows = rows.withColumns({"n": F.length("seq"), "h": F.expr("length(seq) div 2")})
    made = rows.select(
        F.col("doc_id").alias("read_ordinal"),
        F.expr("CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id AS STRING) END").alias("qname"),
        F.expr(FLAG).cast("int").alias("flag"),
        F.col("lang").alias("rname"),
        F.expr("1 + doc_id % 60").alias("pos"),
        F.expr("CAST(doc_id % 5 AS INT)").alias("mapq"),
        F.expr(CIGAR).alias("cigar"),
        "seq",
        F.expr("repeat('I', CAST(n - CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS INT))").alias("qual"),
        F.lit(None).cast("string").alias("md"),
    )
    # Written like a real input: the optimiser then doesn't copy the layout above into the operators' filters.
    return stage_table(made, "query-alignments")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On each language's contig a substitution, deletion or insertion at every tenth place."""
    loci = F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), F.lit(r).alias("ref"), F.lit(a).alias("alt")) for p, (r, a) in zip(PLACES, KINDS * 5)])
    contigs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("chr"), F.upper("lang")).alias("contig")).where("contig IS NOT NULL").distinct()
    rows = contigs.select("contig", F.explode(loci).alias("v")).select("contig", "v.*")
    return rows.withColumn("variant_id", F.concat_ws(":", "contig", "pos"))


def _shown(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Columns that may be null as text, null as 'none'."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in columns})


def _shown_sql(sql: str, columns: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f"coalesce(CAST({c} AS VARCHAR), 'none') AS {c}" for c in columns)}) FROM ({sql})"


EFFECT_NULLS = ("original_protein_sequence", "mutant_protein_sequence")
RESULT_NULLS = (
    "num_cdna_mismatches_in_top_protein_sequence", "num_amino_acid_mismatches_from_predicted_effect", "num_amino_acid_mismatches_from_reference",
    "protein_sequence", "protein_sequence_contains_deletion", "trimmed_predicted_mutant_protein_sequence", "trimmed_reference_protein_sequence",
    "protein_sequence_matches_predicted_mutation_effect", "protein_sequence_matches_reference", "protein_sequence_different_from_reference",
)


def usable_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alignments(spark, sf_dir)
    strict = reads.ReadOptions(min_mapping_quality=3, use_duplicates=True, use_secondary=False)
    kept = lambda o, name: reads.usable_alignments(rows, o).select(F.lit(name).alias("options"), F.col("read_ordinal").alias("doc_id"))
    return kept(reads.ReadOptions(), "default").unionByName(kept(strict, "strict"))


def locus_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.locus_reads(_variants(spark, sf_dir), _alignments(spark, sf_dir))
    mapped = F.col("mapped")
    # Behind a generator: listed once for both columns that are made of it.
    listed = found.withColumn("mapped", F.explode(F.array(F.filter("reference_positions", lambda p: p.isNotNull()))))
    return listed.select(
        "variant_id",
        F.col("read_ordinal").alias("doc_id"),
        "reference_base0_start",
        "reference_base0_end",
        "read_base0_start",
        "read_base0_end",
        F.length("sequence").alias("n_bases"),
        F.size("quality_scores").alias("n_qualities"),
        F.size(mapped).alias("n_mapped"),
        F.aggregate(mapped, F.lit(0).cast("long"), lambda s, p: s + p).alias("sum_of_positions"),
    )


def _locus_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    variants = _variants(spark, sf_dir)
    return variants, reads.read_evidence(variants, reads.allele_reads(reads.locus_reads(variants, _alignments(spark, sf_dir))))


def locus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From variants and alignments to counts of every variant."""
    found = evidence.counts_for_variants(*_locus_evidence(spark, sf_dir))
    return found.select("variant_id", *[f"num_{c}_{u}" for c in (*evidence.CLASSES, "total") for u in evidence.UNITS])


def evidence_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants, found = _locus_evidence(spark, sf_dir)
    return results.read_evidence_frame(found, variants)


def allele_counts_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants, found = _locus_evidence(spark, sf_dir)
    return results.allele_counts_frame(evidence.counts_for_variants(variants, found), variants)


def allele_reads_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of every variant, with the genes of two transcripts that lie on each contig."""
    variants, found = _locus_evidence(spark, sf_dir)
    span = lambda a, z: F.struct(F.lit(a).cast("long").alias("start"), F.lit(z).cast("long").alias("end"))
    first = F.struct(F.lit("ta").alias("transcript_id"), F.lit("ga").alias("gene_name"), F.array(span(1, 55)).alias("exons"))
    second = F.struct(F.lit("tb").alias("transcript_id"), F.lit("gb").alias("gene_name"), F.array(span(40, 60), span(90, 95)).alias("exons"))
    transcripts = variants.select("contig").distinct().select("contig", F.explode(F.array(first, second)).alias("x")).select("contig", "x.*")
    return results.allele_reads_frame(found, variants, transcripts)


def merged_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads of a document that overlap by 20; by id the second differs in one base, of equal or lower quality, or agrees."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", _letters("ACGT").alias("dna")).where("length(dna) >= 40 AND lang IS NOT NULL")
    other = F.expr("CASE WHEN doc_id % 3 < 2 THEN concat(substr(dna, 11, 10), translate(substr(dna, 21, 1), 'ACGT', 'CGTA'), substr(dna, 22, 19)) ELSE substr(dna, 11, 30) END")
    both = F.array(
        F.struct(F.lit(0).alias("k"), F.expr("substr(dna, 1, 30)").alias("seq"), F.lit("I" * 30).alias("qual")),
        F.struct(F.lit(1).alias("k"), other.alias("seq"), F.expr("repeat(CASE WHEN doc_id % 3 = 1 THEN '5' ELSE 'I' END, 30)").alias("qual")),
    )
    rows = d.select("doc_id", "lang", F.explode(both).alias("r")).select(
        (F.col("doc_id") * 2 + F.col("r.k")).alias("read_ordinal"),
        F.col("doc_id").cast("string").alias("qname"),
        F.lit(0).alias("flag"),
        F.col("lang").alias("rname"),
        (101 + 10 * F.col("r.k")).cast("long").alias("pos"),
        F.lit(60).alias("mapq"),
        F.lit("30M").alias("cigar"),
        "r.seq",
        "r.qual",
        F.lit(None).cast("string").alias("md"),
    )
    variants = d.select(F.col("lang").alias("contig")).distinct().select(F.col("contig").alias("variant_id"), "contig", F.lit(116).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    found = reads.locus_reads(variants, rows, reads.ReadOptions(merge_overlapping_mates=True))
    qualities = F.aggregate("quality_scores", F.lit(0).cast("long"), lambda s, q: s + q)
    return found.select("variant_id", "name", "sequence", "source_read_count", "read_base0_start", "read_base0_end", qualities.alias("sum_of_qualities"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each document on a contig of its own: 6 nucleotides, ATG, the document's codons, TAA, 6 nucleotides; two exons, strand by id."""
    d = _dna(spark, sf_dir).where("length(dna) >= 60").withColumn("body", F.expr("substr(dna, 1, length(dna) div 3 * 3)"))
    d = d.withColumn("sequence", F.concat(F.lit("ACGTACATG"), "body", F.lit("TAAGGTTGG"))).withColumns({"n": F.length("sequence"), "h": F.expr("length(sequence) div 2")})
    d = d.withColumn("protein", F.concat(F.lit("M"), dna.translate(F.concat("body", F.lit("TAA")))["amino_acids"]))
    span = lambda a, z: F.struct(F.expr(a).cast("long").alias("start"), F.expr(z).cast("long").alias("end"))
    forward = F.array(span("1001", "1000 + h"), span("1101 + h", "1100 + n"))
    backward = F.array(span("1101 + n - h", "1100 + n"), span("1001", "1000 + n - h"))
    made = d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("transcript_id"),
        F.lit("t").alias("transcript_name"),
        F.lit("g").alias("gene_id"),
        F.lit("gene").alias("gene_name"),
        F.concat(F.lit("chr"), "doc_id").alias("contig"),
        F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.lit("protein_coding").alias("biotype"),
        F.lit(True).alias("complete"),
        F.when(F.col("doc_id") % 2 == 0, forward).otherwise(backward).alias("exons"),
        "sequence",
        F.lit(6).alias("start_codon_offset"),
        (F.length("protein") * 3 + 6).cast("int").alias("stop_codon_offset"),
        "protein",
        "n",
        "h",
    )
    return stage_table(made, "query-transcripts")


#: Offset of a transcript's variant, its genomic place, and its alleles in the transcript's direction.
AT = "CAST(CASE WHEN doc_id % 10 = 1 THEN 2 ELSE 9 + doc_id * 37 % (n - 19) END AS INTEGER)"
PLACE = """CASE WHEN doc_id % 7 = 0 THEN 1050 + CASE WHEN doc_id % 2 = 0 THEN h ELSE n - h END
    WHEN doc_id % 2 = 0 THEN 1001 + t + CASE WHEN t >= h THEN 100 ELSE 0 END ELSE 1000 + n - t + CASE WHEN t < h THEN 100 ELSE 0 END END"""
OLD = "CASE WHEN doc_id % 4 < 2 THEN substr(sequence, t + 1, 1) ELSE '' END"
NEW = "CASE doc_id % 4 WHEN 0 THEN translate(substr(sequence, t + 1, 1), 'ACGT', 'CGTA') WHEN 1 THEN '' WHEN 2 THEN 'GG' ELSE 'GGT' END"


def _transcript_variants(transcripts: DataFrame) -> DataFrame:
    rows = transcripts.withColumn("t", F.expr(AT)).withColumns({"old": F.expr(OLD), "new": F.expr(NEW)})
    genomic = lambda c: F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {c} ELSE reverse(translate({c}, 'ACGT', 'TGCA')) END")
    made = rows.select(
        F.col("doc_id").alias("variant_id"), F.col("doc_id").cast("string").alias("contig"), F.expr(PLACE).cast("long").alias("pos"), genomic("old").alias("ref"), genomic("new").alias("alt")
    )
    return stage_table(made, "query-variants")


def reference_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = _transcripts(spark, sf_dir)
    found = contexts.reference_contexts(_transcript_variants(transcripts), transcripts, 30)
    return found.select("variant_id", *contexts.KEY, F.size("transcripts").alias("n_transcripts"), "max_cds", "mitochondrial", "context_rank")


def reference_contexts_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = _transcripts(spark, sf_dir)
    variants = _transcript_variants(transcripts)
    return results.reference_contexts_frame(contexts.reference_contexts(variants, transcripts, 30), variants)


def transcript_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = _transcripts(spark, sf_dir)
    found = effects.transcript_effects(_transcript_variants(transcripts), transcripts)
    shown = _shown(found, EFFECT_NULLS)
    return shown.select("variant_id", "effect_class", "modifies_protein_sequence", *EFFECT_NULLS, "coding", "transcript_length")


def _line_effects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "lineitem")
    kinds = F.array(*map(F.lit, effects.PRIORITY))
    kind = F.element_at(kinds, (1 + (F.col("l_linenumber") * 5 + F.col("l_suppkey")) % 15).cast("int"))
    found = rows.select(
        F.col("l_partkey").alias("variant_id"),
        kind.alias("effect_class"),
        F.lower(kind).alias("effect_description"),
        kind.isin(*effects.CHANGES_PROTEIN).alias("modifies_protein_sequence"),
        F.col("l_suppkey").cast("string").alias("transcript_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("complete"),
        F.col("l_quantity").cast("int").alias("transcript_length"),
        F.lit(True).alias("coding"),
    )
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id")), found


def transcript_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most severe effect on listed transcripts, on all for variants that have none of those."""
    top = effects.top_effects(*_line_effects(spark, sf_dir), [str(k) for k in range(1, 9)])
    return _shown(top, ("transcript_id",)).select("variant_id", "effect_class", "effect_description", "modifies_protein_sequence", "transcript_id")


def variant_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique sequences of each source's commonest middle nucleotide, collapsed and ranked, without assembly."""
    d = _dna(spark, sf_dir).where("length(dna) >= 8").withColumn("n", F.floor(F.length("dna") / 2))
    rows = d.select(
        F.col("source").alias("variant_id"),
        F.col("doc_id").alias("read_ordinal"),
        dna.slice_text(F.col("dna"), F.lit(0), F.col("n")).alias("prefix"),
        dna.slice_text(F.col("dna"), F.col("n"), F.col("n") + 1).alias("allele"),
        dna.slice_text(F.col("dna"), F.col("n") + 1, F.length("dna")).alias("suffix"),
        F.col("doc_id").cast("string").alias("name"),
        F.lit(1).cast("long").alias("source_read_count"),
    )
    made = assembly.variant_sequences(rows, assembly.SequenceOptions(length=15, coverage=1))
    return made.select("variant_id", "seq_rank", "prefix", "alt", "suffix", "sequence", F.col("n_reads").cast("int").alias("n_reads"))


def translated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of each document laid against its own surroundings, which differ by id, and translated."""
    d = _dna(spark, sf_dir).where("length(dna) >= 62")
    d = d.withColumns(
        {
            "p": F.expr("substr(dna, 9, 22)"),
            "s": F.expr("concat(CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE substr(dna, 32, 1) END, substr(dna, 33, 23))"),
            "before": F.expr("concat(substr(dna, 1, 26), CASE doc_id % 4 WHEN 0 THEN 'ACGT' WHEN 1 THEN 'AAAA' ELSE substr(dna, 27, 4) END)"),
            "plus": F.col("doc_id") % 2 == 0,
        }
    )
    flip = lambda c: dna.reverse_complement(F.col(c))
    d = d.withColumns({"prefix": F.when(F.col("plus"), F.col("p")).otherwise(flip("s")), "suffix": F.when(F.col("plus"), F.col("s")).otherwise(flip("p"))})
    read = F.struct("prefix", F.when(F.col("plus"), "G").otherwise("C").alias("allele"), "suffix", F.lit("r").alias("name"), F.lit(1).cast("long").alias("source_read_count"))
    sequences = d.select(F.col("doc_id").alias("variant_id"), "prefix", F.when(F.col("plus"), "G").otherwise("C").alias("alt"), "suffix", F.array(read).alias("reads"))
    around = d.select(
        F.col("doc_id").alias("variant_id"),
        F.when(F.col("plus"), "+").otherwise("-").alias("strand"),
        F.col("before").alias("sequence_before_variant_locus"),
        F.expr("element_at(array('T', '', 'TC'), CAST(1 + doc_id % 3 AS INT))").alias("sequence_at_variant_locus"),
        F.expr("substr(dna, 32, 30)").alias("sequence_after_variant_locus"),
        (F.col("doc_id") % 3).cast("int").alias("offset_to_first_complete_codon"),
        (F.col("doc_id") % 7 == 0).alias("mitochondrial"),
    )
    options = proteins.ProteinOptions(length=10)
    made = proteins.translations(proteins.match_frames(sequences, around, options), options)
    return made.select("variant_id", *proteins.TRANSLATION_KEY, "orf.cdna_sequence", "orf.offset_to_first_complete_codon", "orf.num_mismatches_before_variant", "orf.num_mismatches_after_variant")


def protein_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q")).distinct()
    rows = rows.withColumns(
        {
            "amino_acids": F.expr("substr(repeat('ACDEFGHIKL', 3), 1, CAST(20 + l_linenumber AS INT))"),
            "contains_mutation": F.expr("l_partkey % 5 <> 0"),
            "mutation_start_idx": F.expr("q % 18"),
            "mutation_end_idx": F.expr("CAST(q % 18 + l_partkey % 4 AS INT)"),
            "ends_with_stop_codon": F.expr("l_orderkey % 2 = 0"),
            "frameshift": F.expr("l_orderkey % 3 = 0"),
        }
    )
    cut = proteins.subsequence(rows, F.expr("CAST(l_partkey % 9 - 3 AS INT)"), F.expr("CASE WHEN l_orderkey % 4 <> 0 THEN CAST(q % 26 - 2 AS INT) END"))
    return cut.select("l_orderkey", "l_linenumber", "l_partkey", "q", *proteins.TRANSLATION_KEY)


def default_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.with_fractions(evidence.allele_counts(_evidence(spark, sf_dir)))
    flags = {f: F.when(F.col("variant_id") % (k + 3) > 0, F.col("variant_id") % (k + 4) > 0) for k, f in enumerate(filters.DEFAULT_FLAGS)}
    out = filters.with_filters(rows.withColumns(flags))
    names = [c for c in out.columns if c.startswith(filters.PREFIX)]
    return out.select("variant_id", *[F.col(f"`{c}`").alias(c.replace(":", "_")) for c in names], "passes_all_filters")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, best proteins and predicted effects of parts, as one row each."""
    part = _table(spark, sf_dir, "part")
    variants = part.select(F.col("p_partkey").alias("variant_id"), F.lit("1").alias("contig"), F.col("p_partkey").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    made = proteins.protein_sequences(_translated(spark, sf_dir).where("variant_id % 6 <> 0"), proteins.ProteinOptions(per_variant=2))
    listed = F.array("p_brand")
    known = part.select(
        F.col("p_partkey").alias("variant_id"),
        F.lit("p.A1C").alias("effect_description"),
        F.lit("Substitution").alias("effect_class"),
        F.lit(True).alias("modifies_protein_sequence"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_brand END").alias("gene_name"),
        *[F.lit("x").alias(c) for c in ("gene_id", "transcript_id", "transcript_name")],
        F.expr("CASE WHEN p_partkey % 4 <> 0 THEN 'NOAF' END").alias("original_protein_sequence"),
        F.expr("CAST(p_partkey % 3 AS INT)").alias("aa_mutation_start_offset"),
        F.lit(4).alias("aa_mutation_end_offset"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'RFXX' WHEN 1 THEN 'XAFX' END").alias("mutant_protein_sequence"),
    )
    over = part.select(F.col("p_partkey").alias("variant_id"), *[listed.alias(f"overlapping_{c}") for c in ("gene_names", "gene_ids", "coding_gene_names", "coding_gene_ids", "transcript_ids", "coding_transcript_ids")])
    counts = evidence.counts_for_variants(variants, _evidence(spark, sf_dir))
    rows = results.results(variants, counts, made, known, over)
    return _shown(rows, RESULT_NULLS).select(
        "variant",
        "num_alt_reads",
        "num_total_fragments",
        "num_protein_sequences",
        "num_fragments_supporting_top_protein_sequence",
        "num_reads_supporting_top_protein_sequence",
        "num_transcripts_from_protein_sequences",
        "num_transcripts_from_top_protein_sequence",
        "num_cdna_mismatches_in_top_protein_sequence",
        "num_mutant_amino_acids_in_protein_sequence",
        "num_overlapping_genes",
        "has_mutant_protein_sequence_from_rna",
        "has_mutant_protein_sequence_from_predicted_effect",
        "protein_sequence",
        "protein_sequence_contains_deletion",
        "trimmed_predicted_mutant_protein_sequence",
        "trimmed_reference_protein_sequence",
        "num_amino_acid_mismatches_from_predicted_effect",
        "num_amino_acid_mismatches_from_reference",
        "protein_sequence_matches_predicted_mutation_effect",
        "protein_sequence_matches_reference",
        "protein_sequence_different_from_reference",
        "top_gene_name",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        usable_alignments, locus_reads, locus_counts, evidence_frame, allele_counts_frame, allele_reads_frame, reference_contexts_frame, merged_mates, reference_contexts, transcript_effects, transcript_whitelist,
        variant_sequences, translated_frames, protein_subsequences, default_filters, result_rows,
    )
}

# Aligned blocks of a read: n1 bases from read offset o1 at p1, and n2 from o2 at p2; "tail" bases are clipped at the end.
_ALIGNED = f"""d AS (SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents WHERE lang IS NOT NULL),
    m AS (SELECT *, length(seq) AS n, length(seq) // 2 AS h, doc_id % 6 AS c, doc_id % 60 AS p1 FROM d WHERE length(seq) >= 40),
    a AS (SELECT *, {FLAG} AS flag, CASE WHEN c = 1 THEN 3 ELSE 0 END AS o1, CASE WHEN c = 2 THEN 4 ELSE 0 END AS tail,
        CASE WHEN c = 1 THEN n - 3 WHEN c = 2 THEN n - 4 WHEN c = 0 THEN n ELSE h END AS n1,
        CASE WHEN c IN (3, 5) THEN n - h WHEN c = 4 THEN n - h - 2 ELSE 0 END AS n2, h + CASE WHEN c = 4 THEN 2 ELSE 0 END AS o2,
        p1 + h + CASE c WHEN 3 THEN 5 WHEN 5 THEN 50 ELSE 0 END AS p2 FROM m),
    sound AS (SELECT * FROM a WHERE doc_id % 17 <> 0 AND flag <> 4 AND doc_id % 13 <> 0 AND doc_id % 19 <> 0),
    usable AS (SELECT * FROM sound WHERE flag <> 1024 AND doc_id % 5 >= 1)"""
_LOCI = f"""v AS (SELECT DISTINCT lang, unnest({[dict(pos=p, r=r, t=t) for p, (r, t) in zip(PLACES, KINDS * 5)]}) AS x FROM documents WHERE lang IS NOT NULL),
    w AS (SELECT lang, 'chr' || upper(lang) || ':' || x.pos AS variant_id, 'chr' || upper(lang) AS chr, x.pos AS pos, x.r AS r, x.t AS t,
        CASE x.r || x.t WHEN 'AC' THEN 'A' WHEN 'ACA' THEN 'C' ELSE '' END AS tr, CASE x.r || x.t WHEN 'AC' THEN 'C' WHEN 'AAG' THEN 'G' ELSE '' END AS ta FROM v),
    l AS (SELECT *, CASE WHEN tr = 'A' THEN pos ELSE pos + CASE WHEN tr = 'C' THEN 1 ELSE 0 END END AS tp,
        CASE WHEN tr = 'A' THEN pos - 1 ELSE pos END AS s, pos + CASE WHEN tr = 'C' THEN 1 ELSE 0 END AS e FROM w)"""


def _at(x: str) -> str:
    return f"CASE WHEN {x} >= p1 AND {x} < p1 + n1 THEN o1 + {x} - p1 WHEN n2 > 0 AND {x} >= p2 AND {x} < p2 + n2 THEN o2 + {x} - p2 END"


_READS = f"""{_ALIGNED}, {_LOCI},
    met AS (SELECT usable.*, l.* EXCLUDE (lang), {_at("(s - 1)")} AS b, {_at("s")} AS f, {_at("e")} AS g, {_at("(e - 1)")} AS k FROM usable JOIN l USING (lang)
        WHERE (p1 < e + 1 AND p1 + n1 > greatest(0, s - 1)) OR (n2 > 0 AND p2 < e + 1 AND p2 + n2 > greatest(0, s - 1))),
    cut AS (SELECT *, CASE WHEN tr <> '' THEN coalesce(f, b + 1) WHEN b IS NULL AND f IS NULL THEN NULL ELSE coalesce(b + 1, o1) END - o1 AS begin_at,
        CASE WHEN tr <> '' THEN coalesce(g, k + 1) WHEN b IS NULL AND f IS NULL THEN NULL ELSE coalesce(f, n - tail) END - o1 AS end_at,
        substr(seq, o1 + 1, n - tail - o1) AS bases FROM met),
    reads AS (SELECT * FROM cut WHERE begin_at >= 0 AND end_at >= begin_at AND end_at <= length(bases))"""
_ALLELES = f"""{_READS}, alleles AS (SELECT *, substr(bases, begin_at + 1, end_at - begin_at) AS allele FROM reads),
    kept AS (SELECT *, CASE allele WHEN tr THEN 'ref' WHEN ta THEN 'alt' ELSE 'other' END AS kind FROM alleles WHERE NOT contains(allele, 'N'))"""
_ACIDS = "codons(codon, acid, mito) AS (VALUES {})".format(
    ", ".join(f"('{c}', '{a}', {str(m).lower()})" for m in (False, True) for c, a in dna.codon_table(m).items())
)
_TRANSCRIPTS = f"""{_ACIDS}, d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS x FROM documents),
    b AS (SELECT doc_id, 'ACGTACATG' || substr(x, 1, length(x) // 3 * 3) || 'TAAGGTTGG' AS sequence FROM d WHERE length(x) >= 60),
    z AS (SELECT *, length(sequence) AS n, length(sequence) // 2 AS h FROM b),
    y AS (SELECT doc_id, unnest(range(2, n // 3)) AS i, sequence FROM z),
    q AS (SELECT doc_id, split_part(string_agg(acid, '' ORDER BY i), '*', 1) AS protein FROM y JOIN codons ON codon = substr(sequence, i * 3 + 1, 3) AND NOT mito GROUP BY doc_id),
    r AS (SELECT z.*, protein, 6 + 3 * length(protein) AS stop, {AT} AS t FROM z JOIN q USING (doc_id)),
    u AS (SELECT *, {OLD} AS old, {NEW} AS new, doc_id % 7 = 0 AS off, CASE WHEN doc_id % 4 >= 2 AND doc_id % 2 = 0 THEN t + 1 ELSE t END AS s FROM r)"""
_HALVES = """d AS (SELECT doc_id, source, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS x FROM documents), m AS (SELECT *, length(x) // 2 AS n FROM d WHERE length(x) >= 8),
    a AS (SELECT doc_id, source, substr(x, 1, n) AS p, substr(x, n + 1, 1) AS alt, substr(x, n + 2) AS s FROM m)"""


def _frames_sql() -> str:
    flip = "reverse(translate({}, 'ACGT', 'TGCA'))"
    return f"""WITH {_ACIDS}, d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS x FROM documents),
    e AS (SELECT doc_id, substr(x, 9, 22) AS p, CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE substr(x, 32, 1) END || substr(x, 33, 23) AS s,
        right(substr(x, 1, 26) || CASE doc_id % 4 WHEN 0 THEN 'ACGT' WHEN 1 THEN 'AAAA' ELSE substr(x, 27, 4) END, 22) AS q, substr(x, 32, 24) AS a,
        (3 - (8 - doc_id % 3) % 3) % 3 AS o, abs([1, 0, 2][1 + doc_id % 3] - 1) % 3 <> 0 AS shift, [1, 0, 2][1 + doc_id % 3] <> 1 AS uneven FROM d WHERE length(x) >= 62),
    f AS (SELECT *, p || 'G' || s AS cdna, len(list_filter(range(1, 23), lambda i: substr(p, i, 1) <> substr(q, i, 1))) AS wrong,
        len(list_filter(range(1, 25), lambda i: substr(s, i, 1) <> substr(a, i, 1))) AS after FROM e),
    g AS (SELECT *, unnest(range((47 - o) // 3)) AS i FROM f WHERE wrong <= 2),
    t AS (SELECT doc_id, string_agg(acid, '' ORDER BY i) AS text FROM g JOIN codons ON codon = substr(cdna, o + 3 * i + 1, 3) AND mito = (doc_id % 7 = 0) GROUP BY doc_id),
    k AS (SELECT f.*, split_part(text, '*', 1) AS full_text, contains(text, '*') AS stops FROM f JOIN t USING (doc_id)),
    c AS (SELECT *, least(10, length(full_text)) AS n, length(full_text) > 10 AS cut, (22 - o) // 3 AS a0,
        CASE WHEN shift THEN length(full_text) ELSE (22 - o) // 3 + 1 + CASE WHEN uneven AND (22 - o) % 3 <> 0 THEN 1 ELSE 0 END END AS a1 FROM k),
    r AS (SELECT *, CASE WHEN cut THEN least(a1, 10) ELSE a1 END AS z FROM c)
    SELECT doc_id AS variant_id, left(full_text, 10) AS amino_acids, CASE WHEN a0 = z THEN a0 > 0 AND a0 < n ELSE n > a0 END AS contains_mutation,
    CAST(a0 AS INTEGER) AS mutation_start_idx, CAST(z AS INTEGER) AS mutation_end_idx, stops AND NOT cut AS ends_with_stop_codon, shift AS frameshift, cdna AS cdna_sequence,
    CAST(o AS INTEGER) AS offset_to_first_complete_codon, CAST(wrong AS INTEGER) AS num_mismatches_before_variant, CAST(after AS INTEGER) AS num_mismatches_after_variant FROM r"""


def _default_filters_sql() -> str:
    from .queries import EVIDENCE, _fractions_sql

    flags = [f"coalesce(variant_id % {k + 3} > 0 AND variant_id % {k + 4} > 0, false) AS filter_{f}" for k, f in enumerate(filters.DEFAULT_FLAGS)]
    limits = [f"{t[4:]} {'>=' if t[:3] == 'min' else '<='} {v} AS filter_{t}" for t, v in filters.DEFAULT_THRESHOLDS.items()]
    every = " AND ".join(f"filter_{x}" for x in (*filters.DEFAULT_FLAGS, *filters.DEFAULT_THRESHOLDS))
    return f"WITH {EVIDENCE}, {_fractions_sql()}, f AS (SELECT variant_id, {', '.join(flags + limits)} FROM fractions) SELECT *, {every} AS passes_all_filters FROM f"


def _results_sql() -> str:
    from .queries import EVIDENCE, ORACLE_SQL

    def cost(a: str, b: str) -> str:
        """Least alignment of two letters with two or fewer: shifted by one they cost 2 at least."""
        same = f"CASE WHEN left({a}, 1) = left({b}, 1) THEN 0 ELSE 1 END + CASE WHEN right({a}, 1) = right({b}, 1) THEN 0 ELSE 1 END"
        one = f"CASE WHEN contains({a}, {b}) THEN 1 ELSE 2 END"
        return f"CASE length({b}) WHEN 2 THEN {same} WHEN 1 THEN {one} WHEN 0 THEN 2 END"

    return f"""WITH {EVIDENCE}, ranked AS ({ORACLE_SQL["protein_ranking"]}),
    every AS (SELECT l_partkey AS variant_id, l_returnflag || l_linestatus AS acids, l_suppkey FROM lineitem),
    listed AS (SELECT ranked.variant_id, count(DISTINCT l_suppkey) AS n, count(DISTINCT amino_acids) AS proteins FROM ranked JOIN every ON every.variant_id = ranked.variant_id AND acids = amino_acids GROUP BY ALL),
    top AS (SELECT ranked.*, listed.n, listed.proteins FROM ranked JOIN listed USING (variant_id) WHERE protein_rank = 1 AND variant_id % 6 <> 0),
    a AS (SELECT part.*, top.*, num_alt_reads, num_total_fragments, amino_acids IS NOT NULL AS has, CASE p_partkey % 3 WHEN 0 THEN 'RFXX' WHEN 1 THEN 'XAFX' END AS m,
        CASE WHEN p_partkey % 4 <> 0 THEN 'NOAF' END AS o FROM part LEFT JOIN top ON variant_id = p_partkey LEFT JOIN counts ON counts.variant_id = p_partkey),
    b AS (SELECT *, CASE WHEN has THEN substr(m, CAST(p_partkey % 3 + 1 AS INTEGER), 2) END AS x, CASE WHEN has THEN substr(o, CAST(p_partkey % 3 + 1 AS INTEGER), 2) END AS y FROM a),
    c AS (SELECT *, CAST({cost("amino_acids", "x")} AS INTEGER) AS cx, CAST({cost("amino_acids", "y")} AS INTEGER) AS cy FROM b)
    SELECT '1 g.' || p_partkey || 'A>C' AS variant, coalesce(num_alt_reads, 0) AS num_alt_reads, coalesce(num_total_fragments, 0) AS num_total_fragments, coalesce(proteins, 0) AS num_protein_sequences,
    coalesce(num_supporting_fragments, 0) AS num_fragments_supporting_top_protein_sequence, coalesce(num_supporting_reads, 0) AS num_reads_supporting_top_protein_sequence,
    CAST(coalesce(n, 0) AS INTEGER) AS num_transcripts_from_protein_sequences, CAST(coalesce(n_transcripts, 0) AS INTEGER) AS num_transcripts_from_top_protein_sequence,
    CAST(num_mismatches_before_variant + num_mismatches_after_variant AS BIGINT) AS num_cdna_mismatches_in_top_protein_sequence,
    CASE WHEN has THEN 1 ELSE 0 END AS num_mutant_amino_acids_in_protein_sequence, 1 AS num_overlapping_genes, has AS has_mutant_protein_sequence_from_rna,
    m IS NOT NULL AS has_mutant_protein_sequence_from_predicted_effect, amino_acids AS protein_sequence, CASE WHEN has THEN false END AS protein_sequence_contains_deletion,
    x AS trimmed_predicted_mutant_protein_sequence, y AS trimmed_reference_protein_sequence, cx AS num_amino_acid_mismatches_from_predicted_effect,
    cy AS num_amino_acid_mismatches_from_reference, cx = 0 AS protein_sequence_matches_predicted_mutation_effect, cy = 0 AS protein_sequence_matches_reference,
    cy <> 0 AS protein_sequence_different_from_reference, CASE WHEN has THEN 'g' ELSE p_brand END AS top_gene_name FROM c"""


_PRIORITY = "[" + ", ".join(f"'{p}'" for p in effects.PRIORITY) + "]"
_CHANGES = ", ".join(f"'{p}'" for p in effects.CHANGES_PROTEIN)

ORACLE_SQL: dict[str, str] = {
    "usable_alignments": f"WITH {_ALIGNED} SELECT 'default' AS options, doc_id FROM usable UNION ALL SELECT 'strict', doc_id FROM sound WHERE flag <> 256 AND doc_id % 5 >= 3",
    "locus_reads": f"""WITH {_READS} SELECT variant_id, doc_id, CAST(s AS BIGINT) AS reference_base0_start, CAST(e AS BIGINT) AS reference_base0_end,
        CAST(begin_at AS BIGINT) AS read_base0_start, CAST(end_at AS BIGINT) AS read_base0_end, CAST(length(bases) AS INTEGER) AS n_bases,
        CAST(length(bases) AS INTEGER) AS n_qualities, CAST(n1 + n2 AS INTEGER) AS n_mapped,
        CAST(n1 * p1 + n1 * (n1 - 1) // 2 + n2 * p2 + n2 * (n2 - 1) // 2 AS BIGINT) AS sum_of_positions FROM reads""",
    "locus_counts": f"""WITH {_ALLELES}, c AS (SELECT variant_id, {", ".join(f"count(*) FILTER (kind = '{c}') AS num_{c}_reads, count(DISTINCT doc_id) FILTER (kind = '{c}') AS num_{c}_fragments" for c in evidence.CLASSES)},
        count(*) AS num_total_reads, count(DISTINCT doc_id) AS num_total_fragments FROM kept GROUP BY ALL)
        SELECT l.variant_id, {", ".join(f"coalesce(num_{c}_{u}, 0) AS num_{c}_{u}" for c in (*evidence.CLASSES, "total") for u in evidence.UNITS)} FROM l LEFT JOIN c USING (variant_id)""",
    "evidence_frame": f"""WITH {_ALLELES}, c AS (SELECT variant_id, {", ".join(f"count(*) FILTER (kind = '{c}') AS {c}_reads" for c in evidence.CLASSES)} FROM kept GROUP BY ALL)
        SELECT chr, CAST(pos AS BIGINT) AS pos, r AS ref, t AS alt, CAST(tp AS BIGINT) AS trimmed_base1_start, tr AS trimmed_ref, ta AS trimmed_alt,
        {", ".join(f"coalesce({c}_reads, 0) AS {c}_reads" for c in evidence.CLASSES)} FROM l LEFT JOIN c USING (variant_id)""",
    "allele_counts_frame": f"""WITH {_ALLELES}, c AS (SELECT variant_id, {", ".join(f"count(*) FILTER (kind = '{c}') AS num_{c}_reads, count(DISTINCT doc_id) FILTER (kind = '{c}') AS num_{c}_fragments" for c in evidence.CLASSES)} FROM kept GROUP BY ALL)
        SELECT chr, CAST(pos AS BIGINT) AS pos, r AS ref, t AS alt, {", ".join(f"coalesce(num_{c}_{u}, 0) AS num_{c}_{u}" for c in evidence.CLASSES for u in evidence.UNITS)} FROM l LEFT JOIN c USING (variant_id)""",
    "allele_reads_frame": f"""WITH {_ALLELES}, x AS (SELECT *, regexp_replace(substr(bases, 1, begin_at), '^.*N', '') AS prefix, split_part(substr(bases, end_at + 1), 'N', 1) AS suffix FROM kept)
        SELECT chr, CAST(pos AS BIGINT) AS pos, r AS ref, t AS alt, prefix, allele, suffix, CAST(doc_id AS VARCHAR) AS name, prefix || allele || suffix AS sequence, kind AS allele_class,
        concat_ws(';', CASE WHEN tp BETWEEN 1 AND 55 THEN 'ga' END, CASE WHEN tp BETWEEN 40 AND 95 THEN 'gb' END) AS gene FROM x""",
    "reference_contexts_frame": f"""WITH {_TRANSCRIPTS}, k AS (SELECT *, s + length(old) AS e, least(s, 30) AS w, s - 6 AS away FROM u WHERE NOT off AND s >= 9 AND s < stop + 3),
        o AS (SELECT *, CAST(CASE WHEN w >= away THEN 6 - (s - w) ELSE (3 - (s - w - 6) % 3) % 3 END AS INTEGER) AS skip FROM k),
        g AS (SELECT *, CASE WHEN w >= away THEN away // 3 ELSE (w - skip) // 3 END AS c, {PLACE} AS pos FROM o)
        SELECT CAST(doc_id AS VARCHAR) AS chr, CAST(pos AS BIGINT) AS pos, CASE WHEN doc_id % 2 = 0 THEN old ELSE reverse(translate(old, 'ACGT', 'TGCA')) END AS ref,
        CASE WHEN doc_id % 2 = 0 THEN new ELSE reverse(translate(new, 'ACGT', 'TGCA')) END AS alt, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
        substr(sequence, s - w + 1, w) AS sequence_before_variant_locus, old AS sequence_at_variant_locus, substr(sequence, e + 1, 30) AS sequence_after_variant_locus,
        skip AS offset_to_first_complete_codon, w >= away AS contains_start_codon, w > away - 3 AS overlaps_start_codon, w > away AS contains_five_prime_utr,
        substr(protein, CAST(away // 3 - c + 1 AS BIGINT), CAST(c AS BIGINT)) AS amino_acids_before_variant, 't' AS transcripts, false AS mitochondrial, 'gene' AS gene FROM g""",
    "merged_mates": """WITH d AS (SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS x FROM documents), m AS (SELECT * FROM d WHERE length(x) >= 40 AND lang IS NOT NULL)
        SELECT lang AS variant_id, CAST(doc_id AS VARCHAR) AS name, substr(x, 1, 40) AS sequence, CAST(2 AS BIGINT) AS source_read_count, CAST(15 AS BIGINT) AS read_base0_start, CAST(16 AS BIGINT) AS read_base0_end,
        CAST(1200 + 10 * CASE WHEN doc_id % 3 = 1 THEN 20 ELSE 40 END AS BIGINT) AS sum_of_qualities FROM m WHERE doc_id % 3 <> 0
        UNION ALL SELECT lang, CAST(doc_id AS VARCHAR), substr(x, 1, 30), 1, 15, 16, 1200 FROM m WHERE doc_id % 3 = 0
        UNION ALL SELECT lang, CAST(doc_id AS VARCHAR), substr(x, 11, 10) || translate(substr(x, 21, 1), 'ACGT', 'CGTA') || substr(x, 22, 19), 1, 5, 6, 1200 FROM m WHERE doc_id % 3 = 0""",
    "reference_contexts": f"""WITH {_TRANSCRIPTS}, k AS (SELECT *, s + length(old) AS e, least(s, 30) AS w, s - 6 AS away FROM u WHERE NOT off AND s >= 9 AND s < stop + 3),
        o AS (SELECT *, CAST(CASE WHEN w >= away THEN 6 - (s - w) ELSE (3 - (s - w - 6) % 3) % 3 END AS INTEGER) AS skip FROM k),
        g AS (SELECT *, CASE WHEN w >= away THEN away // 3 ELSE (w - skip) // 3 END AS c FROM o)
        SELECT doc_id AS variant_id, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(sequence, s - w + 1, w) AS sequence_before_variant_locus, old AS sequence_at_variant_locus,
        substr(sequence, e + 1, 30) AS sequence_after_variant_locus, skip AS offset_to_first_complete_codon, w >= away AS contains_start_codon, w > away - 3 AS overlaps_start_codon,
        w > away AS contains_five_prime_utr, substr(protein, CAST(away // 3 - c + 1 AS BIGINT), CAST(c AS BIGINT)) AS amino_acids_before_variant, 1 AS n_transcripts,
        CAST(stop - 3 AS INTEGER) AS max_cds, false AS mitochondrial, 1 AS context_rank FROM g""",
    "transcript_effects": f"""WITH {_TRANSCRIPTS}, k AS (SELECT *, substr(sequence, 1, s) || new || substr(sequence, s + length(old) + 1) AS changed FROM u WHERE NOT off AND s >= 6 AND s < stop + 3),
        y2 AS (SELECT doc_id, unnest(range(3, length(changed) // 3)) AS i, changed FROM k),
        p2 AS (SELECT doc_id, 'M' || split_part(string_agg(acid, '' ORDER BY i), '*', 1) AS mutant FROM y2 JOIN codons ON codon = substr(changed, i * 3 + 1, 3) AND NOT mito GROUP BY doc_id),
        e AS (SELECT u.*, mutant, CASE WHEN off THEN 'Intronic' WHEN s < 6 THEN 'FivePrimeUTR' WHEN s >= stop + 3 THEN 'ThreePrimeUTR' WHEN protein = mutant THEN 'Silent'
        WHEN abs(length(old) - length(new)) % 3 <> 0 THEN 'FrameShift' WHEN starts_with(protein, mutant) THEN 'PrematureStop' WHEN starts_with(mutant, protein) THEN 'StopLoss'
        WHEN length(old) = length(new) THEN 'Substitution' WHEN new = '' THEN 'Deletion' WHEN old = '' THEN 'Insertion' ELSE 'ComplexSubstitution' END AS kind FROM u LEFT JOIN p2 USING (doc_id))
        SELECT doc_id AS variant_id, kind AS effect_class, kind IN ({_CHANGES}) AS modifies_protein_sequence, CASE WHEN kind IN ({_CHANGES}, 'Silent') THEN protein END AS original_protein_sequence,
        CASE WHEN kind IN ({_CHANGES}) THEN mutant END AS mutant_protein_sequence, true AS coding, CAST(n AS INTEGER) AS transcript_length FROM e""",
    "transcript_whitelist": f"""WITH e AS (SELECT l_partkey AS variant_id, {_PRIORITY}[1 + (l_linenumber * 5 + l_suppkey) % 15] AS k, CAST(l_suppkey AS VARCHAR) AS transcript_id,
        CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS complete, CAST(l_quantity AS INTEGER) AS n, l_suppkey BETWEEN 1 AND 8 AS listed FROM lineitem),
        r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY listed DESC, list_position({_PRIORITY}, k) DESC, complete DESC NULLS LAST, n DESC, transcript_id) = 1)
        SELECT p_partkey AS variant_id, coalesce(k, 'Intergenic') AS effect_class, lower(coalesce(k, 'intergenic')) AS effect_description, coalesce(k IN ({_CHANGES}), false) AS modifies_protein_sequence,
        transcript_id FROM part LEFT JOIN r ON variant_id = p_partkey""",
    "variant_sequences": f"""WITH {_HALVES}, c AS (SELECT source, alt, count(*) AS k, min(doc_id) AS seen FROM a GROUP BY ALL),
        modal AS (SELECT source, alt FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC, seen) = 1),
        r AS (SELECT source, alt, right(p, 7) AS p, left(s, 7) AS s, doc_id FROM a JOIN modal USING (source, alt)),
        q AS (SELECT source, alt, p, s, min(doc_id) AS seen FROM r GROUP BY ALL),
        o AS (SELECT *, length(p) + length(s) AS n, row_number() OVER (PARTITION BY source ORDER BY length(p) + length(s) DESC, seen) AS k FROM q),
        i AS (SELECT x.source, x.k, min(y.k) AS big FROM o x JOIN o y ON x.source = y.source AND y.k < x.k AND ends_with(y.p, x.p) AND starts_with(y.s, x.s) GROUP BY ALL),
        g AS (SELECT o.source, coalesce(i.big, o.k) AS k, count(DISTINCT doc_id) AS reads FROM o LEFT JOIN i ON i.source = o.source AND i.k = o.k
            JOIN r ON r.source = o.source AND r.p = o.p AND r.s = o.s GROUP BY ALL),
        f AS (SELECT o.*, reads, max(n) OVER (PARTITION BY source) AS most FROM o JOIN g USING (source, k))
        SELECT source AS variant_id, CAST(row_number() OVER (PARTITION BY source ORDER BY reads DESC, seen) AS INTEGER) AS seq_rank, p AS prefix, alt, s AS suffix, p || alt || s AS sequence,
        CAST(reads AS INTEGER) AS n_reads FROM f WHERE n + 1 >= least(most + 1, 15)""",
    "translated_frames": _frames_sql(),
    "protein_subsequences": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
        a AS (SELECT *, CAST(20 + l_linenumber AS INTEGER) AS n, q % 18 AS s, q % 18 + l_partkey % 4 AS e, l_partkey % 9 - 3 AS i, CASE WHEN l_orderkey % 4 <> 0 THEN q % 26 - 2 END AS j FROM r),
        b AS (SELECT *, greatest(0, least(n, CASE WHEN i < 0 THEN i + n ELSE i END)) AS x, greatest(0, least(n, CASE WHEN coalesce(j, n) < 0 THEN j + n ELSE coalesce(j, n) END)) AS w FROM a),
        c AS (SELECT *, greatest(w, x) - x AS size, greatest(w, x) AS z FROM b), d AS (SELECT *, least(greatest(s - x, 0), size) AS u FROM c),
        f AS (SELECT *, least(greatest(e - x, u), size) AS v FROM d)
        SELECT l_orderkey, l_linenumber, l_partkey, q, substr(repeat('ACDEFGHIKL', 3), CAST(x + 1 AS INTEGER), CAST(size AS INTEGER)) AS amino_acids,
        l_partkey % 5 <> 0 AND CASE WHEN s <> e THEN v > u WHEN u = v THEN u > 0 AND u < size ELSE size > u END AS contains_mutation, CAST(u AS INTEGER) AS mutation_start_idx,
        CAST(v AS INTEGER) AS mutation_end_idx, l_orderkey % 2 = 0 AND z = n AS ends_with_stop_codon, l_orderkey % 3 = 0 AND v > u AS frameshift FROM f""",
    "default_filters": _default_filters_sql(),
    "result_rows": _results_sql(),
}
for _name, _columns in (("transcript_effects", EFFECT_NULLS), ("transcript_whitelist", ("transcript_id",)), ("result_rows", RESULT_NULLS)):
    ORACLE_SQL[_name] = _shown_sql(ORACLE_SQL[_name], _columns)
