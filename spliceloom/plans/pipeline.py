"""All stages from variants and alignments to filtered, phased results. Each stage is a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import phasing
from ..operators.assembly import SequenceOptions, sequences_with_reads, variant_sequences
from ..operators.contexts import reference_contexts
from ..operators.effects import overlap_summary, top_effects, transcript_effects
from ..operators.evidence import counts_for_variants
from ..operators.filters import DEFAULT_FLAGS, DEFAULT_THRESHOLDS, with_filters
from ..operators.proteins import ProteinOptions, match_frames, protein_sequences, translations
from ..operators.reads import ReadOptions, allele_reads, locus_reads, read_evidence
from ..operators.results import results, with_phasing
from .scratch import stage_table


@dataclass(frozen=True)
class Options:
    """Parameters of a run. ``Options()`` is the library's preset, ``Options.command_line()`` the commands'."""

    reads: ReadOptions = field(default_factory=lambda: ReadOptions(merge_overlapping_mates=True))
    proteins: ProteinOptions = field(default_factory=ProteinOptions)
    coverage: int = 2
    assembly: bool = False
    min_overlap: int = 30
    thresholds: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    flags: Sequence[str] = DEFAULT_FLAGS
    min_shared_fragments: int = 2
    whitelist: list[str] | None = None
    context_size: int | None = None
    sequence_length: int | None = None

    @classmethod
    def command_line(cls, **changes) -> Options:
        few = ("min_ratio_alt_to_other_fragments", "min_fraction_alt_fragments", "min_num_alt_fragments", "min_num_alt_reads")
        return replace(cls(reads=ReadOptions(), assembly=True, thresholds={k: DEFAULT_THRESHOLDS[k] for k in few}), **changes)

    @property
    def sequences(self) -> SequenceOptions:
        return SequenceOptions(self.sequence_length or self.proteins.cdna_length, self.coverage, self.assembly, self.min_overlap)


class Run:
    """The stages of one run by name.

    Stages that several others read are written once to the shared folder when they
    are first asked for; the others are plans.
    """

    def __init__(self, variants: DataFrame, alignments: DataFrame | None, transcripts: DataFrame | None, options: Options = Options(), contigs: DataFrame | None = None) -> None:
        self.variants, self.alignments, self.transcripts, self.options, self.contigs = variants, alignments, transcripts, options, contigs

    @cached_property
    def locus_reads(self) -> DataFrame:
        return locus_reads(self.variants, self.alignments, self.options.reads, self.contigs)

    @cached_property
    def evidence(self) -> DataFrame:
        return stage_table(read_evidence(self.variants, allele_reads(self.locus_reads)), "evidence")

    @property
    def alt_reads(self) -> DataFrame:
        return self.evidence.where("allele_class = 'alt'")

    @cached_property
    def counts(self) -> DataFrame:
        return counts_for_variants(self.variants, self.evidence)

    @cached_property
    def contexts(self) -> DataFrame:
        size = self.options.context_size or self.options.proteins.cdna_length
        return stage_table(reference_contexts(self.variants, self.transcripts, size, self.options.whitelist), "contexts")

    @cached_property
    def effects(self) -> DataFrame:
        return stage_table(transcript_effects(self.variants, self.transcripts), "effects")

    @cached_property
    def sequences(self) -> DataFrame:
        return variant_sequences(self.alt_reads, self.options.sequences)

    @cached_property
    def translatable(self) -> tuple[DataFrame, DataFrame]:
        """Sequences and reads of variants with a context: the rest is left out before any assembly."""
        known = self.contexts.select("variant_id").distinct()
        sequences, reads = sequences_with_reads(self.alt_reads.join(known, "variant_id", "left_semi"), self.options.sequences)
        return stage_table(sequences, "sequences"), stage_table(reads, "reads-of-sequences")

    @cached_property
    def translations(self) -> DataFrame:
        frames = stage_table(match_frames(self.translatable[0], self.contexts, self.options.proteins), "frames")
        return stage_table(translations(frames, self.options.proteins), "translations")

    @cached_property
    def proteins(self) -> DataFrame:
        return stage_table(protein_sequences(self.translations, self.options.proteins, self.translatable[1]), "proteins")

    def phased_by_reads(self) -> DataFrame:
        return phasing.phased_pairs(phasing.shared_names(self.alt_reads), self.options.min_shared_fragments)

    def phased_in_proteins(self) -> DataFrame:
        best = self.proteins.where("protein_rank = 1").select("variant_id", F.explode("translations.seq_rank").alias("seq_rank")).distinct()
        names = self.translatable[1].join(best, ["variant_id", "seq_rank"], "left_semi").select("variant_id", "name")
        return phasing.phased_pairs(phasing.shared_names(names), self.options.min_shared_fragments)

    def results(self) -> DataFrame:
        effects = top_effects(self.variants, self.effects, self.options.whitelist)
        rows = results(self.variants, self.counts, self.proteins, effects, overlap_summary(self.effects))
        rows = with_phasing(rows, self.phased_by_reads(), self.phased_in_proteins())
        return with_filters(rows, self.options.thresholds, self.options.flags)


def run(variants: DataFrame, alignments: DataFrame, transcripts: DataFrame, options: Options = Options()) -> DataFrame:
    """Results of all stages, one row per variant."""
    return Run(variants, alignments, transcripts, options).results()
