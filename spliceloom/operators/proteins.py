"""Reading frames, translations and ranked protein sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import left_part, mismatches_after, mismatches_before, reverse_complement, right_part, slice_text, translate
from ..functions.reach import covering, kth_longest, reach_of, reads_in
from .contexts import KEY

TRANSLATION_KEY = ("amino_acids", "contains_mutation", "mutation_start_idx", "mutation_end_idx", "ends_with_stop_codon", "frameshift")


@dataclass(frozen=True)
class ProteinOptions:
    """How cDNA is matched to transcripts, and how much protein is kept."""

    length: int = 20
    per_variant: int | None = 1
    min_prefix: int = 10
    max_mismatches: int = 2
    count_after: bool = False
    attempts: int = 3

    @property
    def cdna_length(self) -> int:
        return (self.length + 1) * 3


def codon_offset_after_trim(offset: Column, trimmed: Column) -> Column:
    """Offset to the first complete codon once ``trimmed`` nucleotides are gone from the left."""
    return F.when(trimmed <= offset, offset - trimmed).otherwise((3 - (trimmed - offset) % 3) % 3)


def oriented_orf(p: Column, a: Column, s: Column, before: Column, after: Column, offset: Column) -> Column:
    """A sequence (prefix, allele, suffix) in the transcript's direction laid against a reference context, prefixes cut to one length."""
    n = F.least(F.length(p), F.length(before))
    cdna_before, reference_before = right_part(p, n), right_part(before, n)
    return F.struct(
        F.concat(cdna_before, a, s).alias("cdna_sequence"),
        codon_offset_after_trim(offset, F.length(before) - n).cast("int").alias("offset_to_first_complete_codon"),
        n.cast("int").alias("variant_cdna_interval_start"),
        (n + F.length(a)).cast("int").alias("variant_cdna_interval_end"),
        reference_before.alias("reference_cdna_sequence_before_variant"),
        after.alias("reference_cdna_sequence_after_variant"),
        mismatches_before(reference_before, cdna_before).alias("num_mismatches_before_variant"),
        mismatches_after(after, s).alias("num_mismatches_after_variant"),
    )


def match_frames(sequences: DataFrame, contexts: DataFrame, options: ProteinOptions = ProteinOptions()) -> DataFrame:
    """Every sequence against every context of its variant, with ``orf`` where they match.

    A sequence with too many mismatches is cut to the positions that one read more
    covers and tried again, up to ``attempts`` times. An attempt only moves the
    numbers of nucleotides kept on either side: distances of the mismatches from
    the variant are found once before, and how far reads reach are histograms
    (left_reach, right_reach), made of a list of ``reads`` if they aren't given.
    """
    if "left_reach" not in sequences.columns:
        sequences = sequences.withColumns({"left_reach": reach_of(F.col("reads"), "prefix"), "right_reach": reach_of(F.col("reads"), "suffix")})
    rows = sequences.join(contexts, "variant_id")
    plus = F.col("strand") == "+"
    before, after, offset = (F.col(c) for c in (KEY[1], KEY[3], KEY[4]))
    turned = lambda a, b: F.when(plus, F.col(a)).otherwise(reverse_complement(F.col(b)))
    rows = rows.withColumns({"_p": turned("prefix", "suffix"), "_a": turned("alt", "alt"), "_s": turned("suffix", "prefix")})
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    differs_before = F.filter(up_to(F.least(F.length("_p"), F.length(before))), lambda i: F.substring("_p", -i, one) != F.substring(before, -i, one))
    differs_after = F.filter(up_to(F.least(F.length("_s"), F.length(after))), lambda i: F.substring("_s", i, one) != F.substring(after, i, one))
    reach = lambda a, b: F.when(plus, F.col(a)).otherwise(F.col(b))
    rows = rows.withColumns({"_left": reach("left_reach", "right_reach"), "_right": reach("right_reach", "left_reach"), "_before": differs_before, "_after": differs_after})
    left, right = F.col("_left"), F.col("_right")

    def attempt(state: Column, _: Column) -> Column:
        p, s = state["p"], state["s"]
        within = lambda places, n: F.size(F.filter(places, lambda x: x <= n))
        wrong = within(F.col("_before"), p)
        if options.count_after:
            wrong = wrong + within(F.col("_after"), s) + F.greatest(F.lit(0), s - F.length(after))
        closed = state["closed"] | (p < options.min_prefix)
        found = state["found"] | (~closed & (wrong <= options.max_mismatches))
        k = F.least(covering(left, p), covering(right, s))  # reads over every position
        enough = reads_in(left) > k
        cut = lambda n, reached: F.when(found, n).when(enough, F.least(n, F.coalesce(kth_longest(reached, k + 1), F.lit(0)))).otherwise(0)
        fields = {"p": cut(p, left), "s": cut(s, right), "gone": F.when(found, state["gone"]).otherwise(~enough), "closed": closed, "found": found}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    no = F.lit(False)
    start = F.struct(F.length("_p").alias("p"), F.length("_s").alias("s"), no.alias("gone"), no.alias("closed"), no.alias("found"))
    tried = F.aggregate(F.sequence(F.lit(1), F.lit(options.attempts)), start, attempt)
    rows = rows.withColumn("_m", F.explode(F.filter(F.array(tried), lambda state: state["found"])))
    allele = F.when(F.col("_m.gone"), "").otherwise(F.col("_a"))
    rows = rows.withColumns({"_p": right_part(F.col("_p"), F.col("_m.p")), "_a": allele, "_s": left_part(F.col("_s"), F.col("_m.s"))})
    orf = oriented_orf(F.col("_p"), F.col("_a"), F.col("_s"), before, after, offset)
    return rows.withColumn("orf", orf).drop("_p", "_a", "_s", "_left", "_right", "_before", "_after", "_m", "left_reach", "right_reach")


def mutant_interval(coding_before: Column, n_alt: Column, n_ref: Column, n_acids: Column) -> Column:
    """Struct (start, end, frameshift): the changed amino acids of a translation."""
    start = F.floor(coding_before / 3)
    shift = F.abs(n_ref - n_alt) % 3 != 0
    codons = F.ceil(n_alt / 3)
    extra = F.when((n_ref != n_alt) & (coding_before % 3 != 0), 1).otherwise(0)
    end = F.when(shift, n_acids).otherwise(start + codons + extra)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), shift.alias("frameshift"))


def has_mutation(start: Column, end: Column, length: Column) -> Column:
    """Whether a protein shows its mutation; a deletion needs an amino acid on either side."""
    return F.when(start == end, (start > 0) & (start < length)).otherwise(length > start)


def translations(frames: DataFrame, options: ProteinOptions = ProteinOptions()) -> DataFrame:
    """Translations of matched sequences, cut to the protein length."""
    cdna, offset = F.col("orf.cdna_sequence"), F.col("orf.offset_to_first_complete_codon")
    begin, end = F.col("orf.variant_cdna_interval_start"), F.col("orf.variant_cdna_interval_end")
    # Sequences with an unknown codon before the stop have no translation.
    rows = frames.withColumn("_c", slice_text(cdna, offset, F.length(cdna)))
    made = F.filter(F.array(translate(F.col("_c"), F.col("mitochondrial"))), lambda t: t["amino_acids"].isNotNull())
    rows = rows.withColumn("_t", F.explode(made)).drop("_c")
    coding = F.greatest(begin - offset, F.lit(0))
    rows = rows.withColumn("_m", mutant_interval(coding, end - begin, F.length("sequence_at_variant_locus"), F.length("_t.amino_acids")))
    full = F.col("_t.amino_acids")
    long = (F.length(full) > options.length) if options.length else F.lit(False)
    acids = F.when(long, F.substring(full, 1, options.length or 0)).otherwise(full)
    rows = rows.withColumns(
        {
            "amino_acids": acids,
            "mutation_start_idx": F.col("_m.start"),
            "mutation_end_idx": F.when(long, F.least("_m.end", F.lit(options.length or 0))).otherwise(F.col("_m.end")),
            "ends_with_stop_codon": F.col("_t.ends_with_stop") & ~long,
            "frameshift": F.col("_m.frameshift"),
        }
    ).drop("_t", "_m")
    return rows.withColumn("contains_mutation", has_mutation(F.col("mutation_start_idx"), F.col("mutation_end_idx"), F.length("amino_acids")))


def protein_reads(translated: DataFrame, reads: DataFrame | None) -> DataFrame:
    """The reads behind each protein as rows: variant_id, the key columns and ``read``; once for each translation.

    They come from ``reads`` (see ``sequences_with_reads``), or from a list of ``reads`` in each translation.
    """
    keys = ["variant_id", *TRANSLATION_KEY]
    if reads is None:
        return translated.select(*keys, F.explode("reads").alias("read"))
    of = reads.select("variant_id", "seq_rank", F.struct(*[c for c in reads.columns if c not in ("variant_id", "seq_rank")]).alias("read"))
    # A sequence has a few translations to a protein at most, by context: these are one before they meet its reads.
    return translated.select(*keys, "seq_rank").distinct().join(of, ["variant_id", "seq_rank"]).select(*keys, "read")


def protein_sequences(translated: DataFrame, options: ProteinOptions = ProteinOptions(), reads: DataFrame | None = None) -> DataFrame:
    """Translations grouped by equal protein, ranked and cut to the best of each variant.

    Better: more fragments, more reads, fewer mismatches before and after, longer;
    then the first context and sequence. Support counts distinct reads over all
    translations of the protein; mismatches are the least over them. ``reads`` as
    in ``protein_reads``; they are counted in two steps, by name and then by protein.
    """
    t = F.struct("context_rank", "seq_rank", "prefix", "alt", "suffix", "sequence", "strand", "transcripts", "orf")
    keys = ["variant_id", *TRANSLATION_KEY]
    once = protein_reads(translated, reads).groupBy(*keys, "read").agg(F.lit(1).alias("_one"))
    by_name = once.groupBy(*keys, F.col("read.name").alias("_name")).agg(F.count("*").alias("n"), F.sum("read.source_read_count").alias("weight"))
    counts = by_name.groupBy(*keys).agg(F.count("*").alias("num_supporting_fragments"), F.sum("weight").alias("num_supporting_reads"), F.sum("n").alias("num_reads"))
    grouped = translated.groupBy(*keys).agg(
        F.sort_array(F.collect_list(t)).alias("translations"),
        # Apart from the list, which is left out where nothing else needs it.
        F.min(F.struct("context_rank", "seq_rank")).alias("_first"),
        F.min("orf.num_mismatches_before_variant").alias("num_mismatches_before_variant"),
        F.min("orf.num_mismatches_after_variant").alias("num_mismatches_after_variant"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("transcripts")))).alias("transcripts"),
        F.sort_array(F.collect_set("orf.cdna_sequence")).alias("cdna_sequences"),
    )
    # Keys may be null, and a protein without reads stays.
    numbers = ("num_supporting_fragments", "num_supporting_reads", "num_reads")
    same = [grouped[c].eqNullSafe(counts[c]) for c in keys]
    grouped = grouped.join(counts, reduce(and_, same), "left").select(*[grouped[c] for c in grouped.columns], *[F.coalesce(counts[c], F.lit(0)).alias(c) for c in numbers])
    names = lambda f: F.array_sort(F.array_distinct(F.transform("transcripts", lambda x: x[f])))
    rows = grouped.withColumns(
        {
            "num_supporting_fragments": F.col("num_supporting_fragments").cast("int"),
            "num_mismatches": F.col("num_mismatches_before_variant") + F.col("num_mismatches_after_variant"),
            "transcript_ids": names("transcript_id"),
            "transcript_names": names("transcript_name"),
            "gene_ids": names("gene_id"),
            "gene_names": names("gene_name"),
        }
    )
    order = Window.partitionBy("variant_id").orderBy(
        F.desc("num_supporting_fragments"),
        F.desc("num_supporting_reads"),
        "num_mismatches_before_variant",
        "num_mismatches_after_variant",
        F.desc(F.length("amino_acids")),
        "_first",
        "amino_acids",
    )
    total = F.count("*").over(Window.partitionBy("variant_id"))
    ranked = rows.withColumns({"protein_rank": F.row_number().over(order), "num_protein_sequences": total}).drop("_first")
    if options.per_variant:
        ranked = ranked.where(F.col("protein_rank") <= options.per_variant).withColumn("num_protein_sequences", F.least("num_protein_sequences", F.lit(options.per_variant)))
    return normalize_interval(ranked)


def normalize_interval(proteins: DataFrame) -> DataFrame:
    """Mutation indices cut to the protein; done after grouping, which uses them as translated."""
    n = F.length("amino_acids")
    start = F.least(F.greatest("mutation_start_idx", F.lit(0)), n)
    return proteins.withColumns({"mutation_start_idx": start.cast("int"), "mutation_end_idx": F.least(F.greatest("mutation_end_idx", start), n).cast("int")})


def subsequence(proteins: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Part of each protein, with interval, stop and mutation flags of the part."""
    n = F.length("amino_acids")
    place = lambda x: F.least(F.greatest(F.when(x < 0, x + n).otherwise(x), F.lit(0)), n)
    rows = proteins.withColumns({"_a": place(begin), "_z": F.greatest(place(F.coalesce(end, n)), place(begin))})
    size = F.col("_z") - F.col("_a")
    start = F.least(F.greatest(F.col("mutation_start_idx") - F.col("_a"), F.lit(0)), size)
    stop = F.least(F.greatest(F.col("mutation_end_idx") - F.col("_a"), start), size)
    rows = rows.withColumns({"_s": start, "_e": stop, "_ends": F.col("ends_with_stop_codon") & (F.col("_z") == n), "_was": F.col("mutation_start_idx") == F.col("mutation_end_idx")})
    inside = F.when(F.col("_was"), has_mutation(F.col("_s"), F.col("_e"), size)).otherwise(F.col("_e") > F.col("_s"))
    rows = rows.withColumns(
        {
            "amino_acids": slice_text(F.col("amino_acids"), F.col("_a"), F.col("_z")),
            "contains_mutation": F.col("contains_mutation") & inside,
            "frameshift": F.col("frameshift") & (F.col("_e") > F.col("_s")),
            "mutation_start_idx": F.col("_s").cast("int"),
            "mutation_end_idx": F.col("_e").cast("int"),
            "ends_with_stop_codon": F.col("_ends"),
        }
    )
    return rows.drop("_a", "_z", "_s", "_e", "_ends", "_was")
