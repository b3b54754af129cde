"""Registered queries: the operators bound to the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna, scores
from .functions.variants import base0_interval, short_description, trim_variant
from .operators import assembly, evidence, filters, phasing, proteins, reads
from .streaming.counts import stream_allele_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reads: part = variant, order = fragment, return flag = allele."""
    rows = _table(spark, sf_dir, "lineitem").where("l_quantity >= 1 AND l_linestatus = 'F'")
    allele = F.when(F.col("l_returnflag") == "N", "ref").when(F.col("l_returnflag") == "A", "alt").otherwise("other")
    return rows.select(
        F.col("l_partkey").alias("variant_id"), F.col("l_orderkey").alias("name"), allele.alias("allele_class"), F.col("l_linenumber").cast("long").alias("source_read_count")
    )


EVIDENCE = """
evidence AS (
    SELECT l_partkey AS variant_id, l_orderkey AS name, CAST(l_linenumber AS BIGINT) AS n,
           CASE l_returnflag WHEN 'N' THEN 'ref' WHEN 'A' THEN 'alt' ELSE 'other' END AS allele_class
    FROM lineitem WHERE l_quantity >= 1 AND l_linestatus = 'F'
), counts AS (
    SELECT variant_id,
           CAST(coalesce(sum(n) FILTER (allele_class = 'ref'), 0) AS BIGINT) AS num_ref_reads,
           CAST(coalesce(sum(n) FILTER (allele_class = 'alt'), 0) AS BIGINT) AS num_alt_reads,
           CAST(coalesce(sum(n) FILTER (allele_class = 'other'), 0) AS BIGINT) AS num_other_reads,
           count(DISTINCT name) FILTER (allele_class = 'ref') AS num_ref_fragments,
           count(DISTINCT name) FILTER (allele_class = 'alt') AS num_alt_fragments,
           count(DISTINCT name) FILTER (allele_class = 'other') AS num_other_fragments,
           count(DISTINCT name) AS num_total_fragments
    FROM evidence GROUP BY variant_id
)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 THEN 0.0 WHEN {b} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST({a} AS DOUBLE) / {b} END"


def _fractions_sql() -> str:
    total = "(num_ref_reads + num_alt_reads + num_other_reads)"
    parts = [f"{_ratio(f'num_{c}_{u}', total if u == 'reads' else 'num_total_fragments')} AS fraction_{c}_{u}" for c in evidence.CLASSES for u in evidence.UNITS]
    parts += [f"{_ratio(f'num_{a}_{u}', f'num_{b}_{u}')} AS ratio_{a}_to_{b}_{u}" for a, b in evidence.RATIOS for u in evidence.UNITS]
    return f"fractions AS (SELECT *, {total} AS num_total_reads, {', '.join(parts)} FROM counts)"


DNA = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"


def _letters(letters: str) -> Column:
    """Only these letters of a text, taken out by runs of others; behind a generator, so filters and cuts don't do it again."""
    return F.explode(F.array(F.regexp_replace(F.upper("text"), f"[^{letters}]+", "")))


def _dna(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> DataFrame:
    """Documents reduced to nucleotides: (doc_id, source, dna)."""
    rows = _table(spark, sf_dir, "documents")
    return rows.select("doc_id", "source", _letters(letters).alias("dna"))


def allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.allele_counts(_evidence(spark, sf_dir))


def allele_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.with_fractions(evidence.allele_counts(_evidence(spark, sf_dir)))


def filter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = allele_fractions(spark, sf_dir).withColumn("has_alt", F.col("num_alt_reads") > 0)
    out = filters.with_filters(rows, {"min_num_alt_reads": 3, "max_fraction_other_fragments": 0.5, "min_ratio_alt_to_other_fragments": 1.0}, ["has_alt", "not_has_alt"])
    names = [c for c in out.columns if c.startswith(filters.PREFIX)]
    return out.select("variant_id", *[F.col(f"`{c}`").alias(c.replace(":", "_")) for c in names], "passes_all_filters")


def read_evidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("allele"))
    return rows.withColumn("allele_class", reads.classify(rows, F.lit("N"), F.lit("A"))).groupBy("l_partkey", "allele_class").agg(F.count("*").alias("n_reads"))


def modal_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    ordinal = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + F.when(flag == "N", 0).when(flag == "A", 1).otherwise(2)
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("variant_id"), flag.alias("allele"), ordinal.alias("read_ordinal"))
    return reads.modal_allele(rows).groupBy("variant_id", "allele").agg(F.count("*").alias("n_reads"))


def unique_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir).where("length(dna) >= 3")
    n = F.floor(F.length("dna") / 2)
    parts = d.select(
        F.col("source").alias("variant_id"),
        dna.slice_text(F.col("dna"), F.lit(0), n).alias("prefix"),
        dna.slice_text(F.col("dna"), n, n + 1).alias("allele"),
        dna.slice_text(F.col("dna"), n + 1, F.length("dna")).alias("suffix"),
        F.col("doc_id").cast("string").alias("name"),
        F.lit(1).cast("long").alias("source_read_count"),
        F.col("doc_id").alias("read_ordinal"),
    )
    return evidence.unique_sequences(parts, 45, 44).select("variant_id", "prefix", "alt", "suffix", F.col("n_reads").cast("int").alias("n_reads"), "seen")


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("doc_id", dna.reverse_complement(F.col("dna")).alias("reverse_complement"))


def n_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir, "ACGTN")
    return d.select("doc_id", dna.after_last_n(F.col("dna")).alias("prefix"), dna.before_first_n(F.col("dna")).alias("suffix"))


def translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir).withColumn("t", dna.translate(F.col("dna")))
    return d.select("doc_id", "t.amino_acids", "t.ends_with_stop")


def distinct_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("doc_id", F.size(dna.kmers(F.col("dna"), 6)).alias("n_kmers"))


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir)
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("dna").alias("other"))
    both = d.join(other, "doc_id")
    return both.select("doc_id", dna.hamming(F.col("dna"), F.col("other")).alias("mismatches"), dna.mismatches_after(F.col("dna"), F.col("other")).alias("mismatches_after"))


def trimmed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir).where("length(dna) >= 6")
    ref, alt = F.expr("substr(dna, 1, CAST(length(dna) div 2 + doc_id % 3 AS INT))"), F.expr("substr(dna, 1, CAST(length(dna) div 2 + doc_id * 7 % 4 AS INT))")
    alt = F.when(F.col("doc_id") % 5 == 0, F.reverse(alt)).otherwise(alt)
    t = d.select("doc_id", ref.alias("ref"), alt.alias("alt")).where("ref <> alt").withColumn("t", trim_variant(F.col("doc_id"), F.col("ref"), F.col("alt")))
    i = base0_interval(F.col("t.pos"), F.col("t.ref"))
    return t.select("doc_id", F.col("t.pos").alias("pos"), F.col("t.ref").alias("trimmed_ref"), F.col("t.alt").alias("trimmed_alt"), i["start"].alias("locus_start"), i["end"].alias("locus_end"))


def variant_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir).where("length(dna) >= 6")
    ref, alt = F.expr("substr(dna, 1, CAST(length(dna) div 2 AS INT))"), F.expr("substr(dna, 1, CAST(length(dna) div 2 + doc_id % 4 - 1 AS INT))")
    return d.where(ref != alt).select("doc_id", short_description(F.lit("chr1"), F.col("doc_id"), ref, alt).alias("description"))


def allele_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir, "ACGTN").where("length(dna) >= 20")
    start = F.col("doc_id") % 11
    rows = d.select(
        F.lit(1).alias("variant_id"),
        F.col("doc_id").alias("read_ordinal"),
        F.col("source").alias("name"),
        F.col("dna").alias("sequence"),
        F.lit(1).alias("source_read_count"),
        start.alias("read_base0_start"),
        (start + F.col("doc_id") % 3).alias("read_base0_end"),
    )
    return reads.allele_reads(rows).select(F.col("read_ordinal").alias("doc_id"), "prefix", "allele", "suffix", "sequence")


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dna(spark, sf_dir).where("length(dna) > 0")
    positions = F.sequence(F.lit(0).cast("long"), F.length("dna").cast("long") - 1)
    return reads.base_counts_by_position(d.select(F.col("source").alias("variant_id"), F.col("dna").alias("sequence"), positions.alias("reference_positions")))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer within 30 days of a shipment by the supplier of the same number."""
    at = F.unix_timestamp
    shipped = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), at("l_shipdate").alias("s"), (at("l_shipdate") + 30 * 86400).alias("e"))
    ordered = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("rk"), at("o_orderdate").alias("rs"), (at("o_orderdate") + 1).alias("re"))
    return reads.interval_join(shipped, ordered, ("k", "s", "e"), ("rk", "rs", "re"), 15 * 86400).select("l_orderkey", "l_linenumber", "o_orderkey")


def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation")
    wanted = nations.select(F.concat(F.lit("chr"), F.lower("n_name")).alias("contig"), F.col("n_nationkey").alias("variant_id"))
    return reads.reconcile_contigs(wanted, nations.select(F.col("n_name").alias("rname"))).select("variant_id", "contig", "rname")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a 20 + 1 + 20 sequence by line items that reach l_quantity before and l_tax * 1000 / 2 behind it."""
    row = F.struct(
        F.repeat(F.lit("A"), F.col("l_quantity").cast("int")).alias("prefix"),
        F.repeat(F.lit("C"), F.round(F.col("l_tax") * 500).cast("int")).alias("suffix"),
        F.col("l_orderkey").alias("name"),
    )
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_list(row).alias("reads"))
    p, a, s = F.lit("A" * 20), F.lit("G"), F.lit("C" * 20)
    t = assembly.trim_by_coverage(p, a, s, F.col("reads"), F.lit(12))
    return rows.select(
        "l_partkey",
        assembly.min_coverage(p, s, F.col("reads")).alias("min_coverage"),
        F.round(assembly.mean_coverage(p, a, s, F.col("reads")), 6).alias("mean_coverage"),
        F.length(t["prefix"]).alias("prefix_kept"),
        F.length(t["suffix"]).alias("suffix_kept"),
    )


def mutant_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey"), F.col("l_quantity").cast("int").alias("q")).distinct()
    m = proteins.mutant_interval(F.col("q"), F.col("l_linenumber") % 5, F.col("l_partkey") % 4, F.lit(30))
    rows = rows.withColumn("m", m)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "q",
        F.col("m.start").alias("start_idx"),
        F.col("m.end").alias("end_idx"),
        F.col("m.frameshift").alias("frameshift"),
        proteins.has_mutation(F.col("m.start"), F.col("m.end"), F.lit(30)).alias("contains_mutation"),
        proteins.codon_offset_after_trim(F.col("l_linenumber"), F.col("q")).cast("int").alias("codon_offset"),
    )


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as translations: part = variant, flag and status = protein, order = read."""
    rows = _table(spark, sf_dir, "lineitem")
    read = F.struct(F.lit("").alias("prefix"), F.lit("").alias("allele"), F.lit("").alias("suffix"), F.col("l_orderkey").cast("string").alias("name"), F.col("l_linenumber").cast("long").alias("source_read_count"))
    orf = F.struct(F.lit("A").alias("cdna_sequence"), F.lit(0).alias("offset_to_first_complete_codon"), (F.col("l_linenumber") % 3).alias("num_mismatches_before_variant"), (F.col("l_quantity").cast("int") % 5).alias("num_mismatches_after_variant"))
    transcript = F.array(F.struct(F.col("l_suppkey").cast("string").alias("transcript_id"), F.lit("t").alias("transcript_name"), F.lit("g").alias("gene_id"), F.lit("g").alias("gene_name")))
    return rows.select(
        F.col("l_partkey").alias("variant_id"),
        F.concat("l_returnflag", "l_linestatus").alias("amino_acids"),
        F.lit(True).alias("contains_mutation"),
        F.lit(0).alias("mutation_start_idx"),
        F.lit(1).alias("mutation_end_idx"),
        F.lit(False).alias("ends_with_stop_codon"),
        F.lit(False).alias("frameshift"),
        F.lit(1).alias("context_rank"),
        F.lit(1).alias("seq_rank"),
        *[F.lit("").alias(c) for c in ("prefix", "alt", "suffix", "sequence")],
        F.lit("+").alias("strand"),
        transcript.alias("transcripts"),
        orf.alias("orf"),
        F.array(read).alias("reads"),
    )


def protein_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = proteins.protein_sequences(_translated(spark, sf_dir), proteins.ProteinOptions(per_variant=2))
    columns = ["variant_id", "amino_acids", "protein_rank", "num_supporting_fragments", "num_supporting_reads", "num_mismatches_before_variant", "num_mismatches_after_variant"]
    return top.select(*columns, F.size("transcript_ids").alias("n_transcripts"))


def _alt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("variant_id"), F.col("l_orderkey").alias("name"))


def phasing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.shared_names(_alt_names(spark, sf_dir))


def phasing_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.partners(phasing.phased_pairs(phasing_counts(spark, sf_dir))).select("variant_id", F.array_join("partners", ";").alias("partners"))


def phase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _alt_names(spark, sf_dir)
    found = phasing.phase_groups(phasing.phased_pairs(phasing.shared_names(names)), names)
    return found.select("phase_group", F.array_join("somatic_variants", ";").alias("variants"), F.size("supporting_read_names").alias("n_supporting_names"))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    allele = F.when(F.col("l_returnflag") == "N", "ref").when(F.col("l_returnflag") == "A", "alt").otherwise("other")
    stream = rows.select(F.col("l_shipdate").alias("ts"), (F.col("l_partkey") % 10).alias("variant_id"), allele.alias("allele_class"), F.col("l_linenumber").alias("source_read_count"))
    counted = stream_allele_counts(stream, window="30 days")
    return counted.select(F.unix_timestamp("window_start").alias("window_start"), "variant_id", "num_ref_reads", "num_alt_reads", "num_other_reads")


def assembled_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences assembled from nucleotides of all documents, by source.

    A document gives two reads over its middle nucleotide: one reaches 15 nucleotides before it and 8 to 13 behind it,
    the other the reverse, so a sequence of full length only comes from merging. Sources of any size are merged.
    """
    d = _dna(spark, sf_dir).where("length(dna) >= 41")
    n, few = F.floor(F.length("dna") / 2), F.lit(8) + F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(6))
    reach = F.array(F.struct(F.lit(0).alias("k"), F.lit(15).cast("long").alias("left"), few.alias("right")), F.struct(F.lit(1).alias("k"), few.alias("left"), F.lit(15).cast("long").alias("right")))
    rows = d.withColumn("x", F.explode(reach)).select(
        F.col("source").alias("variant_id"),
        (F.col("doc_id") * 2 + F.col("x.k")).alias("read_ordinal"),
        dna.slice_text(F.col("dna"), n - F.col("x.left"), n).alias("prefix"),
        dna.slice_text(F.col("dna"), n, n + 1).alias("allele"),
        dna.slice_text(F.col("dna"), n + 1, n + 1 + F.col("x.right")).alias("suffix"),
        F.col("doc_id").cast("string").alias("name"),
        F.lit(1).cast("long").alias("source_read_count"),
    )
    made = assembly.variant_sequences(rows, assembly.SequenceOptions(length=31, coverage=1, assembly=True, min_overlap=10, merge_limit=None))
    return made.select("variant_id", "seq_rank", "prefix", "alt", "suffix", F.col("n_reads").cast("int").alias("n_reads"))


def alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    return rows.select("p_partkey", scores.alignment_score(F.col("p_name"), F.col("p_type")).alias("score"))


def collapsed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents' nucleotides around their middle, by source: each with the longest one that contains it."""
    d = _dna(spark, sf_dir).where("length(dna) >= 41 AND source IS NOT NULL")
    n = F.floor(F.length("dna") / 2)
    rows = d.select(
        F.col("source").alias("variant_id"),
        F.col("doc_id").alias("seen"),
        dna.slice_text(F.col("dna"), n - F.col("doc_id") % 9, n).alias("prefix"),
        dna.slice_text(F.col("dna"), n, n + 1).alias("alt"),
        dna.slice_text(F.col("dna"), n + 1, n + 1 + F.col("doc_id") % 7).alias("suffix"),
    )
    return assembly.with_container(rows).select("variant_id", "seen", "into")


def edit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters in which names and types of parts differ, over the length of the shorter."""
    n = F.least(F.length("p_name"), F.length("p_type"))
    runs = scores.edit_runs(dna.left_part(F.col("p_name"), n), dna.left_part(F.col("p_type"), n), F.lit(0))
    return _table(spark, sf_dir, "part").select("p_partkey", F.explode(runs).alias("r")).select("p_partkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.alt").alias("alt"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        allele_counts, allele_fractions, filter_columns, read_evidence_classes, modal_allele, unique_sequences, reverse_complement, n_trimmed,
        translate, distinct_kmers, hamming, trimmed_variants, variant_descriptions, allele_reads, base_counts, interval_join, contig_names,
        coverage, mutant_intervals, protein_ranking, phasing_counts, phasing_partners, phase_groups, windowed_counts,
        assembled_sequences, alignment_scores, collapsed_sequences, edit_runs,
    )
}

_PAIRS = """
names AS (SELECT DISTINCT l_partkey AS v, l_orderkey AS name FROM lineitem WHERE l_returnflag = 'A'),
pairs AS (SELECT x.v AS a, y.v AS b, count(*) AS n FROM names x JOIN names y USING (name) WHERE x.v < y.v GROUP BY ALL)"""
_HALVES = f"""halves AS (SELECT doc_id, source, d, length(d) // 2 AS n FROM (SELECT doc_id, source, {DNA} AS d FROM documents) WHERE length(d) >= 3)"""
_CODONS = ", ".join(f"('{c}', '{a}')" for c, a in dna.codon_table().items())
_ALLELES = "CASE l_returnflag WHEN 'N' THEN 'ref' WHEN 'A' THEN 'alt' ELSE 'other' END"

ORACLE_SQL: dict[str, str] = {
    "allele_counts": f"WITH {EVIDENCE} SELECT * FROM counts",
    "allele_fractions": f"WITH {EVIDENCE}, {_fractions_sql()} SELECT * FROM fractions",
    "filter_columns": f"""WITH {EVIDENCE}, {_fractions_sql()}, f AS (SELECT variant_id, num_alt_reads > 0 AS filter_has_alt, num_alt_reads <= 0 AS filter_not_has_alt,
        num_alt_reads >= 3 AS filter_min_num_alt_reads, fraction_other_fragments <= 0.5 AS filter_max_fraction_other_fragments,
        ratio_alt_to_other_fragments >= 1.0 AS filter_min_ratio_alt_to_other_fragments FROM fractions)
        SELECT *, filter_has_alt AND filter_not_has_alt AND filter_min_num_alt_reads AND filter_max_fraction_other_fragments
        AND filter_min_ratio_alt_to_other_fragments AS passes_all_filters FROM f""",
    "read_evidence_classes": f"SELECT l_partkey, {_ALLELES} AS allele_class, count(*) AS n_reads FROM lineitem GROUP BY ALL",
    "modal_allele": """WITH c AS (SELECT l_partkey AS variant_id, l_returnflag AS allele, count(*) AS n_reads,
        min(l_orderkey * 1000 + l_linenumber * 10 + CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS seen FROM lineitem GROUP BY ALL)
        SELECT variant_id, allele, n_reads FROM c QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY n_reads DESC, seen) = 1""",
    "unique_sequences": f"""WITH {_HALVES} SELECT source AS variant_id, right(substr(d, 1, n), 45) AS prefix, substr(d, n + 1, 1) AS alt,
        left(substr(d, n + 2), 44) AS suffix, CAST(count(DISTINCT doc_id) AS INTEGER) AS n_reads, min(doc_id) AS seen FROM halves GROUP BY ALL""",
    "reverse_complement": f"SELECT doc_id, reverse(translate({DNA}, 'ACGT', 'TGCA')) AS reverse_complement FROM documents",
    "n_trimmed": """SELECT doc_id, regexp_replace(d, '^.*N', '') AS prefix, split_part(d, 'N', 1) AS suffix
        FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS d FROM documents)""",
    "translate": f"""WITH codons(codon, acid) AS (VALUES {_CODONS}), d AS (SELECT doc_id, {DNA} AS d FROM documents),
        c AS (SELECT doc_id, unnest(range(length(d) // 3)) AS i, d FROM d),
        p AS (SELECT doc_id, string_agg(acid, '' ORDER BY i) AS p FROM c JOIN codons ON codon = substr(d, i * 3 + 1, 3) GROUP BY doc_id)
        SELECT d.doc_id, split_part(coalesce(p, ''), '*', 1) AS amino_acids, contains(coalesce(p, ''), '*') AS ends_with_stop FROM d LEFT JOIN p USING (doc_id)""",
    "distinct_kmers": f"""WITH d AS (SELECT doc_id, {DNA} AS d FROM documents) SELECT doc_id,
        CAST(len(list_distinct(list_transform(range(1, greatest(1, length(d) - 4)), lambda i: substr(d, i, 6)))) AS INTEGER) AS n_kmers FROM d""",
    "hamming": f"""WITH d AS (SELECT doc_id, {DNA} AS d FROM documents), b AS (SELECT x.doc_id, x.d AS a, y.d AS b, least(length(x.d), length(y.d)) AS n
        FROM d x JOIN d y ON y.doc_id = x.doc_id + 1), m AS (SELECT *, len(list_filter(range(1, n + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) AS k FROM b)
        SELECT doc_id, CAST(k AS INTEGER) AS mismatches, CAST(k + greatest(0, length(b) - length(a)) AS INTEGER) AS mismatches_after FROM m""",
    "trimmed_variants": f"""WITH d AS (SELECT doc_id, {DNA} AS d FROM documents), v AS (SELECT doc_id, substr(d, 1, length(d) // 2 + doc_id % 3) AS ref,
        CASE WHEN doc_id % 5 = 0 THEN reverse(substr(d, 1, length(d) // 2 + doc_id * 7 % 4)) ELSE substr(d, 1, length(d) // 2 + doc_id * 7 % 4) END AS alt FROM d WHERE length(d) >= 6),
        t AS (SELECT doc_id, CASE WHEN starts_with(ref, alt) THEN doc_id + length(alt) WHEN starts_with(alt, ref) THEN doc_id + length(ref) - 1 ELSE doc_id END AS pos,
        CASE WHEN starts_with(ref, alt) THEN substr(ref, length(alt) + 1) WHEN starts_with(alt, ref) THEN '' ELSE ref END AS trimmed_ref,
        CASE WHEN starts_with(ref, alt) THEN '' WHEN starts_with(alt, ref) THEN substr(alt, length(ref) + 1) ELSE alt END AS trimmed_alt FROM v WHERE ref <> alt)
        SELECT *, CASE WHEN trimmed_ref = '' THEN pos ELSE pos - 1 END AS locus_start, CASE WHEN trimmed_ref = '' THEN pos ELSE pos - 1 END + length(trimmed_ref) AS locus_end FROM t""",
    "variant_descriptions": f"""WITH v AS (SELECT doc_id, {DNA} AS d FROM documents), h AS (SELECT *, length(d) // 2 AS h, doc_id % 4 AS k FROM v WHERE length(d) >= 6)
        SELECT doc_id, 'chr1 g.' || CASE WHEN k = 0 THEN (doc_id + h - 1) || 'del' || substr(d, h, 1) ELSE (doc_id + h - 1) || '_' || (doc_id + h) || 'ins' || substr(d, h + 1, k - 1) END
        AS description FROM h WHERE k <> 1""",
    "allele_reads": """WITH d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS d FROM documents), r AS (SELECT doc_id,
        regexp_replace(substr(d, 1, doc_id % 11), '^.*N', '') AS prefix, substr(d, doc_id % 11 + 1, doc_id % 3) AS allele,
        split_part(substr(d, doc_id % 11 + doc_id % 3 + 1), 'N', 1) AS suffix FROM d WHERE length(d) >= 20)
        SELECT *, prefix || allele || suffix AS sequence FROM r WHERE NOT contains(allele, 'N')""",
    "base_counts": f"""WITH d AS (SELECT source, {DNA} AS d FROM documents), b AS (SELECT source AS variant_id, unnest(range(length(d))) AS pos, d FROM d)
        SELECT variant_id, pos, count(*) FILTER (substr(d, pos + 1, 1) = 'A') AS "A", count(*) FILTER (substr(d, pos + 1, 1) = 'C') AS "C",
        count(*) FILTER (substr(d, pos + 1, 1) = 'G') AS "G", count(*) FILTER (substr(d, pos + 1, 1) = 'T') AS "T" FROM b GROUP BY ALL""",
    "interval_join": """SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders ON o_custkey = l_suppkey
        AND epoch(o_orderdate)::BIGINT >= epoch(l_shipdate)::BIGINT AND epoch(o_orderdate)::BIGINT < epoch(l_shipdate)::BIGINT + 30 * 86400""",
    "contig_names": "SELECT n_nationkey AS variant_id, 'chr' || lower(n_name) AS contig, n_name AS rname FROM nation",
    "coverage": """WITH r AS (SELECT l_partkey, CAST(l_quantity AS INTEGER) AS p, CAST(round(l_tax * 500) AS INTEGER) AS s FROM lineitem),
        o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY p DESC) AS pr, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC) AS sr FROM r)
        SELECT l_partkey, CAST(least(count(*) FILTER (p >= 20), count(*) FILTER (s >= 20)) AS INTEGER) AS min_coverage,
        round((count(*) + sum(least(p, 20)) + sum(least(s, 20))) / 41.0, 6) AS mean_coverage,
        CAST(coalesce(least(20, max(p) FILTER (pr = 12)), 0) AS INTEGER) AS prefix_kept, CAST(coalesce(least(20, max(s) FILTER (sr = 12)), 0) AS INTEGER) AS suffix_kept
        FROM o GROUP BY l_partkey""",
    "mutant_intervals": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
        x AS (SELECT *, l_linenumber % 5 AS na, l_partkey % 4 AS nr, q // 3 AS start_idx FROM r),
        m AS (SELECT *, abs(nr - na) % 3 <> 0 AS frameshift, CASE WHEN abs(nr - na) % 3 <> 0 THEN 30
        ELSE start_idx + (na + 2) // 3 + CASE WHEN nr <> na AND q % 3 <> 0 THEN 1 ELSE 0 END END AS end_idx FROM x)
        SELECT l_orderkey, l_linenumber, l_partkey, q, start_idx, CAST(end_idx AS INTEGER) AS end_idx, frameshift,
        CASE WHEN start_idx = end_idx THEN start_idx > 0 AND start_idx < 30 ELSE 30 > start_idx END AS contains_mutation,
        CAST(CASE WHEN q <= l_linenumber THEN l_linenumber - q ELSE (3 - (q - l_linenumber) % 3) % 3 END AS INTEGER) AS codon_offset FROM m""",
    "protein_ranking": """WITH t AS (SELECT l_partkey AS variant_id, l_returnflag || l_linestatus AS amino_acids, count(DISTINCT l_orderkey) AS f,
        list_distinct(list((l_orderkey, l_linenumber))) AS reads, min(l_linenumber % 3) AS b, min(CAST(l_quantity AS INTEGER) % 5) AS a,
        count(DISTINCT l_suppkey) AS x FROM lineitem GROUP BY ALL), s AS (SELECT *, CAST(list_sum(list_transform(reads, lambda r: r[2])) AS BIGINT) AS n FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY f DESC, n DESC, b, a, amino_acids) AS k FROM s)
        SELECT variant_id, amino_acids, CAST(k AS INTEGER) AS protein_rank, CAST(f AS INTEGER) AS num_supporting_fragments, n AS num_supporting_reads,
        b AS num_mismatches_before_variant, a AS num_mismatches_after_variant, CAST(x AS INTEGER) AS n_transcripts FROM r WHERE k <= 2""",
    "phasing_counts": f"WITH {_PAIRS} SELECT * FROM pairs",
    "phasing_partners": f"""WITH {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE n >= 2 UNION ALL SELECT b, a FROM pairs WHERE n >= 2)
        SELECT a AS variant_id, string_agg(CAST(b AS VARCHAR), ';' ORDER BY b) AS partners FROM e GROUP BY a""",
    "phase_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE n >= 2 UNION ALL SELECT b, a FROM pairs WHERE n >= 2),
        walk(v, w) AS (SELECT a, a FROM e UNION SELECT walk.v, e.b FROM walk JOIN e ON e.a = walk.w),
        g AS (SELECT v, min(w) AS phase_group FROM walk GROUP BY v),
        s AS (SELECT phase_group, name FROM g JOIN names USING (v) GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT phase_group, count(*) AS n FROM s GROUP BY ALL)
        SELECT phase_group, string_agg(CAST(v AS VARCHAR), ';' ORDER BY v) AS variants, CAST(coalesce(max(n), 0) AS INTEGER) AS n_supporting_names
        FROM g LEFT JOIN k USING (phase_group) GROUP BY phase_group""",
    "alignment_scores": """WITH s AS (SELECT p_partkey, p_name AS a, p_type AS b, unnest(range(1 - length(p_type), length(p_name))) AS shift FROM part),
        k AS (SELECT *, unnest(range(greatest(0, shift), least(length(a), length(b) + shift))) AS k FROM s),
        w AS (SELECT p_partkey, shift, k, CASE WHEN substr(a, k + 1, 1) = substr(b, k - shift + 1, 1) THEN 2 ELSE 1 END AS won FROM k),
        p AS (SELECT *, sum(won) OVER (PARTITION BY p_partkey, shift ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM w),
        g AS (SELECT p_partkey, max(upto - low) AS gain FROM (SELECT *, min(upto - won) OVER (PARTITION BY p_partkey, shift ORDER BY k ROWS UNBOUNDED PRECEDING) AS low FROM p) GROUP BY p_partkey)
        SELECT part.p_partkey, CAST(length(p_name) + length(p_type) - coalesce(gain, 0) AS INTEGER) AS score FROM part LEFT JOIN g USING (p_partkey)""",
    "collapsed_sequences": f"""WITH {_HALVES}, q AS (SELECT source, doc_id, substr(d, n - doc_id % 9 + 1, doc_id % 9) AS p, substr(d, n + 1, 1) AS alt, substr(d, n + 2, doc_id % 7) AS s
            FROM halves WHERE length(d) >= 41 AND source IS NOT NULL)
        SELECT x.source AS variant_id, x.doc_id AS seen, y.doc_id AS into
        FROM q x JOIN q y ON x.source = y.source AND x.alt = y.alt AND ends_with(y.p, x.p) AND starts_with(y.s, x.s)
        QUALIFY row_number() OVER (PARTITION BY x.source, x.doc_id ORDER BY length(y.p) + length(y.s) DESC, y.doc_id) = 1""",
    "edit_runs": """WITH t AS (SELECT p_partkey, p_name AS a, p_type AS b, unnest(range(1, least(length(p_name), length(p_type)) + 1)) AS i FROM part),
        d AS (SELECT p_partkey, i, substr(b, i, 1) AS c, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS run FROM t WHERE substr(a, i, 1) <> substr(b, i, 1))
        SELECT p_partkey, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) AS INTEGER) AS "end", string_agg(c, '' ORDER BY i) AS alt FROM d GROUP BY p_partkey, run""",
    "windowed_counts": f"""WITH r AS (SELECT CAST(epoch(l_shipdate) AS BIGINT) // 2592000 * 2592000 AS window_start, l_partkey % 10 AS variant_id, {_ALLELES} AS c, l_linenumber AS n FROM lineitem)
        SELECT window_start, variant_id, CAST(coalesce(sum(n) FILTER (c = 'ref'), 0) AS BIGINT) AS num_ref_reads,
        CAST(coalesce(sum(n) FILTER (c = 'alt'), 0) AS BIGINT) AS num_alt_reads, CAST(coalesce(sum(n) FILTER (c = 'other'), 0) AS BIGINT) AS num_other_reads FROM r GROUP BY ALL""",
}
