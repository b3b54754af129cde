"""One wide row per variant, and the public frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.dna import slice_text
from ..functions.scores import alignment_score
from ..functions.variants import with_trimmed
from .contexts import overlapping_transcripts
from .effects import described
from .evidence import CLASSES, UNITS
from .filters import PREFIX
from .phasing import partners

EFFECT_COLUMNS = {
    "effect_description": "predicted_effect",
    "effect_class": "predicted_effect_class",
    "modifies_protein_sequence": "predicted_effect_modifies_protein_sequence",
    "gene_name": "predicted_effect_gene_name",
    "gene_id": "predicted_effect_gene_id",
    "transcript_id": "predicted_effect_transcript_id",
    "transcript_name": "predicted_effect_transcript_name",
    "original_protein_sequence": "predicted_effect_original_protein_sequence",
    "aa_mutation_start_offset": "predicted_effect_aa_mutation_start_offset",
    "aa_mutation_end_offset": "predicted_effect_aa_mutation_end_offset",
    "mutant_protein_sequence": "predicted_effect_mutant_protein_sequence",
}
ZERO_WITHOUT_PROTEIN = {
    "num_fragments_supporting_top_protein_sequence": "num_supporting_fragments",
    "num_reads_supporting_top_protein_sequence": "num_supporting_reads",
}
NULL_WITHOUT_PROTEIN = {
    "num_cdna_mismatches_in_top_protein_sequence": "num_mismatches",
    "num_cdna_mismatches_before_variant_in_top_protein_sequence": "num_mismatches_before_variant",
    "num_cdna_mismatches_after_variant_in_top_protein_sequence": "num_mismatches_after_variant",
}


def trimmed_to(protein: Column, acids: Column, effect_start: Column, mutation_start: Column) -> Column:
    """The part of a predicted protein that a protein from reads covers: mutations laid on each other; null without one of them."""
    begin = F.greatest(effect_start - mutation_start, F.lit(0))
    return F.when(acids.isNotNull(), slice_text(protein, begin, begin + F.length(acids)))


def names_from_proteins(proteins: DataFrame, most: int | None = None) -> DataFrame:
    """Sorted transcripts and genes behind the ``most`` best proteins of each variant, of all for None.

    Columns: variant_id, transcript_ids, transcript_names, gene_ids, gene_names.
    """
    if most is not None:
        proteins = proteins.where(F.col("protein_rank") <= most)
    columns = ("transcript_ids", "transcript_names", "gene_ids", "gene_names")
    each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return proteins.groupBy("variant_id").agg(*map(each, columns))


def results(variants: DataFrame, counts: DataFrame, proteins: DataFrame, effects: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Variants with counts, effect, overlaps and best protein; columns that need a protein are null or 0 without."""
    top = proteins.where("protein_rank = 1").drop("protein_rank", "num_reads")
    every = names_from_proteins(proteins).select("variant_id", F.col("transcript_ids").alias("all_transcripts"), F.col("gene_ids").alias("all_genes"))
    effect = effects.select("variant_id", *[F.col(c).alias(n) for c, n in EFFECT_COLUMNS.items()])
    rows = described(variants).join(counts, "variant_id").join(effect, "variant_id", "left").join(overlaps, "variant_id", "left")
    rows = rows.join(top, "variant_id", "left").join(every, "variant_id", "left")
    has = F.col("amino_acids").isNotNull()
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    predicted, reference = F.col("predicted_effect_mutant_protein_sequence"), F.col("predicted_effect_original_protein_sequence")
    begin = F.col("predicted_effect_aa_mutation_start_offset")
    rows = rows.withColumns({n: zero(c) for n, c in ZERO_WITHOUT_PROTEIN.items()} | {n: F.col(c) for n, c in NULL_WITHOUT_PROTEIN.items()})
    rows = rows.withColumns(
        {
            "num_protein_sequences": zero("num_protein_sequences"),
            "num_translations_from_top_protein_sequence": size("translations"),
            "num_cdna_sequences_from_top_protein_sequence": size("cdna_sequences"),
            "num_transcripts_from_top_protein_sequence": size("transcript_ids"),
            "num_genes_from_top_protein_sequence": size("gene_ids"),
            "num_transcripts_from_protein_sequences": size("all_transcripts"),
            "num_genes_from_protein_sequences": size("all_genes"),
            "num_overlapping_genes": size("overlapping_gene_ids"),
            "num_overlapping_coding_genes": size("overlapping_coding_gene_ids"),
            "num_overlapping_transcripts": size("overlapping_transcript_ids"),
            "num_overlapping_coding_transcripts": size("overlapping_coding_transcript_ids"),
            "num_mutant_amino_acids_in_protein_sequence": F.coalesce(F.col("mutation_end_idx") - F.col("mutation_start_idx"), F.lit(0)),
            "has_mutant_protein_sequence_from_rna": has,
            "has_mutant_protein_sequence_from_predicted_effect": predicted.isNotNull(),
            "has_reference_protein_sequence_from_predicted_effect": reference.isNotNull(),
            "protein_sequence": F.col("amino_acids"),
            "protein_sequence_ends_with_stop_codon": F.col("ends_with_stop_codon"),
            "protein_sequence_mutation_start_idx": F.col("mutation_start_idx"),
            "protein_sequence_mutation_end_idx": F.col("mutation_end_idx"),
            "protein_sequence_contains_mutation": F.col("contains_mutation"),
            "protein_sequence_contains_deletion": F.when(has, F.col("contains_mutation") & (F.col("mutation_start_idx") == F.col("mutation_end_idx"))),
            "protein_sequence_gene_names": F.array_join("gene_names", ";"),
            "protein_sequence_gene_ids": F.array_join("gene_ids", ";"),
            "protein_sequence_transcript_names": F.array_join("transcript_names", ";"),
            "protein_sequence_transcript_ids": F.array_join("transcript_ids", ";"),
            "trimmed_predicted_mutant_protein_sequence": trimmed_to(predicted, F.col("amino_acids"), begin, F.col("mutation_start_idx")),
            "trimmed_reference_protein_sequence": trimmed_to(reference, F.col("amino_acids"), begin, F.col("mutation_start_idx")),
            "top_gene_name": F.coalesce(F.get("gene_names", F.lit(0)), "predicted_effect_gene_name", F.get("overlapping_coding_gene_names", F.lit(0)), F.get("overlapping_gene_names", F.lit(0))),
        }
    )
    rows = rows.withColumns(
        {
            "num_amino_acid_mismatches_from_predicted_effect": alignment_score(F.col("protein_sequence"), F.col("trimmed_predicted_mutant_protein_sequence")),
            "num_amino_acid_mismatches_from_reference": alignment_score(F.col("protein_sequence"), F.col("trimmed_reference_protein_sequence")),
        }
    )
    # Null where one of the two proteins is missing: neither agreement nor difference is known.
    same = F.col("num_amino_acid_mismatches_from_reference") == 0
    rows = rows.withColumns(
        {
            "protein_sequence_matches_predicted_mutation_effect": F.col("num_amino_acid_mismatches_from_predicted_effect") == 0,
            "protein_sequence_matches_reference": same,
            "protein_sequence_different_from_reference": ~same,
        }
    )
    unused = ["amino_acids", "ends_with_stop_codon", "mutation_start_idx", "mutation_end_idx", "contains_mutation", "frameshift", "all_transcripts", "all_genes"]
    unused += ["num_supporting_fragments", "num_supporting_reads", "num_mismatches", "num_mismatches_before_variant", "num_mismatches_after_variant"]
    return rows.drop(*unused)


def with_phasing(rows: DataFrame, read_pairs: DataFrame, protein_pairs: DataFrame) -> DataFrame:
    """Results with both kinds of phased partners and their numbers."""
    for pairs, name, count in (
        (read_pairs, "phased_variants_from_reads", "num_phased_variants_from_reads"),
        (protein_pairs, "phased_variants_in_protein_sequence", "num_phased_variants_in_protein_sequence"),
    ):
        found = partners(pairs).withColumnRenamed("partners", name)
        rows = rows.join(found, "variant_id", "left").withColumn(count, F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)))
    return rows


def flattened(rows: DataFrame) -> DataFrame:
    """Results as they are written: fixed column order, quantities in alphabetical order, lists joined by semicolons."""
    listed = ["overlapping_gene_names", "overlapping_gene_ids", "overlapping_coding_gene_names", "overlapping_coding_gene_ids"]
    quantities = sorted(c for c in rows.columns if c.startswith(("num_", "fraction_", "ratio_")))
    has = sorted(c for c in rows.columns if c.startswith("has_"))
    effect = [n for n in EFFECT_COLUMNS.values() if n in rows.columns]
    protein = [
        "protein_sequence", "protein_sequence_ends_with_stop_codon", "protein_sequence_gene_names", "protein_sequence_gene_ids",
        "protein_sequence_transcript_names", "protein_sequence_transcript_ids", "protein_sequence_mutation_start_idx",
        "protein_sequence_mutation_end_idx", "trimmed_predicted_mutant_protein_sequence", "trimmed_reference_protein_sequence",
        "protein_sequence_contains_mutation", "protein_sequence_contains_deletion", "protein_sequence_matches_predicted_mutation_effect",
        "protein_sequence_matches_reference", "protein_sequence_different_from_reference",
    ]
    filters = [c for c in rows.columns if c.startswith(PREFIX)] + ["passes_all_filters"]
    order = [c for c in ["variant", *listed, *quantities, *has, *effect, *protein, *filters] if c in rows.columns]
    text = lambda c: F.array_join(F.col(f"`{c}`"), ";") if isinstance(rows.schema[c].dataType, ArrayType) else F.col(f"`{c}`")
    return rows.select(*[text(c).alias(c) for c in order])


def frame(
    rows: DataFrame,
    variants: DataFrame,
    exclude: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
    converters: Mapping[str, Callable[[Column], Column]] | None = None,
    extra: Mapping[str, Column] | None = None,
    sizes: bool = True,
) -> DataFrame:
    """Rows of an operator with chr, pos, ref and alt of the untrimmed variant in front.

    Lists become their sizes unless ``sizes`` is False. Names in ``exclude`` and
    ``converters`` must be columns, and what is excluded can't be converted.
    """
    rename, converters = rename or {}, converters or {}
    held = [c for c in rows.columns if c != "variant_id"]
    if unknown := [c for c in exclude if c not in held] + [c for c in converters if c not in held or c in exclude]:
        raise ValueError(f"no such columns: {', '.join(unknown)}; there are: {', '.join(held)}")
    columns = []
    for f in rows.schema.fields:
        if f.name in ("variant_id", *exclude):
            continue
        c = rows[f"`{f.name}`"]
        c = converters[f.name](c) if f.name in converters else F.size(c) if sizes and isinstance(f.dataType, ArrayType) else c
        columns.append(c.alias(rename.get(f.name, f.name)))
    columns += [c.alias(n) for n, c in (extra or {}).items()]
    body = rows.select(rows["variant_id"].alias("_variant"), *columns)
    head = variants.select(F.col("variant_id").alias("_variant"), *[F.col(c).alias(f"_{c}") for c in ("contig", "pos", "ref", "alt")])
    first = [F.col("_contig").alias("chr"), *[F.col(f"_{c}").alias(c) for c in ("pos", "ref", "alt")]]
    return body.join(head, "_variant").select(*first, *[body[f"`{c}`"] for c in body.columns[1:]])


def exploded_frame(rows: DataFrame, variants: DataFrame, elements: str, **options) -> DataFrame:
    """``frame`` of the elements of a list column: one row for each, with its fields as columns; none for empty lists."""
    each = rows.select("variant_id", F.explode(elements).alias("_element"))
    return frame(each.select("variant_id", "_element.*"), variants, **options)


def read_evidence_frame(evidence: DataFrame, variants: DataFrame) -> DataFrame:
    """Alleles of each variant and its reads of either class, with multiplicity; 0 where there are none."""
    of = lambda c: F.sum(F.when(F.col("allele_class") == c, F.col("source_read_count")).otherwise(0)).cast("long").alias(f"{c}_reads")
    sums = evidence.groupBy("variant_id").agg(*map(of, CLASSES))
    loci = with_trimmed(variants).select("variant_id", "trimmed_pos", "trimmed_ref", "trimmed_alt")
    rows = loci.join(sums, "variant_id", "left").na.fill(0, [f"{c}_reads" for c in CLASSES])
    return frame(rows, variants, rename={"trimmed_pos": "trimmed_base1_start"})


def gene_names(variants: DataFrame, transcripts: DataFrame | None) -> DataFrame:
    """(variant_id, gene): names of the genes with a transcript over each variant, sorted and joined; empty without any."""
    ids = variants.select("variant_id")
    if transcripts is None:
        return ids.withColumn("gene", F.lit(""))
    spans = transcripts.select("transcript_id", "contig", "exons", "gene_name")
    over = overlapping_transcripts(variants.select("variant_id", "contig", "pos", "ref", "alt"), spans)
    found = over.groupBy("variant_id").agg(F.array_join(F.sort_array(F.collect_set("gene_name")), ";").alias("gene"))
    return ids.join(found, "variant_id", "left").select("variant_id", F.coalesce("gene", F.lit("")).alias("gene"))


def _with_genes(rows: DataFrame, variants: DataFrame, transcripts: DataFrame | None, **options) -> DataFrame:
    """``frame`` with the column gene at the end."""
    genes = gene_names(variants, transcripts)
    joined = rows.join(genes.withColumnsRenamed({"variant_id": "_variant_id", "gene": "_gene"}), F.col("variant_id") == F.col("_variant_id")).drop("_variant_id")
    exclude = ("_gene", *options.pop("exclude", ()))
    return frame(joined, variants, exclude=exclude, extra={"gene": joined["_gene"]}, **options)


def allele_reads_frame(reads: DataFrame, variants: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    return _with_genes(reads, variants, transcripts, exclude=("read_ordinal", "source_read_count", "trimmed_pos", "trimmed_ref", "trimmed_alt"))


def allele_counts_frame(counts: DataFrame, variants: DataFrame) -> DataFrame:
    columns = [f"num_{c}_{u}" for u in UNITS for c in CLASSES]
    return frame(counts.select("variant_id", *columns), variants)


def locus_reads_frame(reads: DataFrame) -> DataFrame:
    """Locus reads with lists joined by semicolons, without variant columns."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), ";").alias(c)
    keep = [c for c in reads.columns if c not in ("variant_id", "read_ordinal", "source_read_count")]
    return reads.select(*[listed(c) if isinstance(reads.schema[c].dataType, ArrayType) else F.col(c) for c in keep])


def variant_sequences_frame(sequences: DataFrame, variants: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    hidden = ("seq_rank", "n_source_reads", "left_reach", "right_reach")
    return _with_genes(sequences, variants, transcripts, exclude=hidden, rename={"alt": "allele", "n_reads": "reads"})


def reference_contexts_frame(contexts: DataFrame, variants: DataFrame) -> DataFrame:
    names = lambda f: lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda x: x[f]))), ";")
    return frame(contexts, variants, exclude=("max_cds", "context_rank"), converters={"transcripts": names("transcript_name")}, extra={"gene": names("gene_name")(contexts["transcripts"])})


def translations_frame(translated: DataFrame, variants: DataFrame) -> DataFrame:
    cdna = translated["orf"]["cdna_sequence"]
    offset = translated["orf"]["offset_to_first_complete_codon"]
    whole = F.length(cdna) - offset
    extra = {
        "untrimmed_variant_sequence": translated["sequence"],
        "reference_context": F.array_join(F.transform(translated["transcripts"], lambda x: x["transcript_name"]), ";"),
        "variant_orf": slice_text(cdna, offset, offset + whole - whole % 3),
        "cdna_sequence": cdna,
        # Reads with multiplicity: merged mates are two.
        "untrimmed_variant_sequence_read_count": translated["n_source_reads"],
    }
    keep = ["variant_id", "amino_acids", "contains_mutation", "mutation_start_idx", "mutation_end_idx", "ends_with_stop_codon", "frameshift"]
    hidden = ("sequence", "orf", "transcripts", "n_source_reads")
    return frame(translated.select(*keep, *hidden), variants, exclude=hidden, extra=extra)


def protein_sequences_frame(proteins: DataFrame, variants: DataFrame) -> DataFrame:
    gene = {"gene": F.array_join(proteins["gene_names"], ";")}
    return frame(proteins, variants, rename={"num_reads": "reads"}, exclude=("protein_rank", "gene_names", "gene_ids", "num_protein_sequences"), extra=gene)

