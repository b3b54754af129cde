"""Assembly of a variant's unique sequences, and the filters that follow it."""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import left_part, right_part
from ..functions.reach import added_up, covering, kth_longest, reads_in, tallied
from ..plans.scratch import stage_table
from .evidence import READ, distinct_reads, unique_sequences
from .reads import modal_allele

INDEX_LENGTH = 15
MERGE_LIMIT = 1000
#: A variant counts as hot if it has this share of all sequences or more; so there are at most as many hot ones.
HOT_SHARE = 1024


@dataclass(frozen=True)
class Sequence:
    """Nucleotides around a variant and the numbers of the reads that have them."""

    prefix: str
    alt: str
    suffix: str
    reads: frozenset

    @property
    def text(self) -> str:
        return self.prefix + self.alt + self.suffix

    def contains(self, other: Sequence) -> bool:
        return self.alt == other.alt and self.prefix.endswith(other.prefix) and self.suffix.startswith(other.suffix)

    def joined(self, other: Sequence, least: int) -> tuple[int, Sequence] | None:
        """Both as one and the nucleotides they share, if those are ``least`` or more.

        Both hold the allele, so they agree if the shorter of their prefixes ends the
        longer one and the shorter of their suffixes begins the longer one.
        """
        p, q = sorted((self.prefix, other.prefix), key=len)
        s, t = sorted((self.suffix, other.suffix), key=len)
        shared = len(p) + len(self.alt) + len(s)
        if self.alt != other.alt or shared < max(1, least) or not (q.endswith(p) and t.startswith(s)):
            return None
        return shared, Sequence(q, self.alt, t, self.reads | other.reads)


def collapse(sequences: list[Sequence]) -> list[Sequence]:
    """Without sequences that a longer one contains; the first such one, longest first, takes their reads.

    Prefixes are kept backwards and sorted, so those that end in a given prefix lie next to each other.
    """
    kept: list[Sequence] = []
    by_allele: dict[str, list[tuple[str, int]]] = {}
    for s in sorted(sequences, key=lambda s: len(s.text), reverse=True):
        backwards, places = s.prefix[::-1], by_allele.setdefault(s.alt, [])
        fits = itertools.takewhile(lambda x: x[0].startswith(backwards), itertools.islice(places, bisect_left(places, (backwards, -1)), None))
        into = min((k for _, k in fits if kept[k].suffix.startswith(s.suffix)), default=None)
        if into is None:
            insort(places, (backwards, len(kept)))
            kept.append(s)
        else:
            kept[into] = replace(kept[into], reads=kept[into].reads | s.reads)
    return kept


def pairs_to_try(sequences: list[Sequence], least: int) -> list[tuple[int, int]]:
    """Pairs of sequences, long enough to overlap, that share a k-mer."""
    usable = [k for k, s in enumerate(sequences) if len(s.text) >= least]
    if not usable:
        return []
    n = max(1, min(INDEX_LENGTH, least, min(len(sequences[k].text) for k in usable)))
    index: dict[str, list[int]] = {}
    for k in usable:
        text = sequences[k].text
        for piece in {text[i : i + n] for i in range(len(text) - n + 1)}:
            index.setdefault(piece, []).append(k)
    return sorted({pair for held in index.values() for pair in itertools.combinations(held, 2)})


def assemble(sequences: list[Sequence], least: int, limit: int | None = MERGE_LIMIT, sizes: Mapping[int, int] | None = None) -> list[Sequence]:
    """Sequences collapsed and merged until none overlap, most reads first.

    More than ``limit`` sequences are only collapsed; None merges all. In a round
    the pair with the longest overlap goes first, then the one with most reads, and
    a sequence is merged once. ``sizes`` says how many reads a number stands for.
    """
    support = lambda s: sum((sizes or {}).get(k, 1) for k in s.reads)
    current = collapse(sequences)
    while limit is None or len(current) <= limit:
        heap: list = []
        for i, j in pairs_to_try(current, least):
            if found := current[i].joined(current[j], least):
                heappush(heap, (-found[0], -support(found[1]), i, j, found[1]))
        if not heap:
            break
        free, made = dict(enumerate(current)), {}
        while heap:
            *_, i, j, both = heappop(heap)
            if i in free and j in free:
                del free[i], free[j]
                same = made.get((both.prefix, both.suffix, both.alt), both)
                made[both.prefix, both.suffix, both.alt] = replace(both, reads=both.reads | same.reads)
        current = [*made.values(), *free.values()]
    return sorted(current, key=support, reverse=True)


def with_container(sequences: DataFrame) -> DataFrame:
    """Sequences with ``into``: the ``seen`` of the longest sequence that contains them, of equals the first seen; their own if none does.

    A container has the contained one's prefix at the end of its own and its suffix at the beginning, so it answers for
    every shape (lengths of prefix and suffix) of its variant that is no longer than itself: what it has in that shape is
    looked up by text. All of this is aggregated before it is shuffled, so one variant's sequences spread over all tasks.
    ``seen`` tells a variant's sequences apart.
    """
    sequences = stage_table(sequences, "sequences-to-collapse")
    shape = F.struct(F.length("prefix").alias("p"), F.length("suffix").alias("s"))
    shapes = stage_table(sequences.groupBy("variant_id").agg(F.collect_set(shape).alias("shapes"), F.count("*").alias("n")), "sequence-shapes")
    hot = F.broadcast(shapes.where(F.col("n") * HOT_SHARE >= sequences.count()).drop("n"))
    keys = sequences.select("variant_id", "prefix", "alt", "suffix", "seen")
    shaped = keys.join(hot, "variant_id").unionByName(
        keys.join(hot.select("variant_id"), "variant_id", "left_anti").join(shapes.drop("n"), "variant_id")
    )
    fits = F.filter("shapes", lambda x: (x["p"] <= F.length("prefix")) & (x["s"] <= F.length("suffix")))
    longest = F.struct((-F.length("prefix") - F.length("suffix")).alias("size"), F.col("seen").alias("into"))
    asked = shaped.select("variant_id", "alt", "prefix", "suffix", longest.alias("longest"), F.explode(fits).alias("x"))
    answers = asked.groupBy("variant_id", "alt", right_part(F.col("prefix"), F.col("x.p")).alias("prefix"), left_part(F.col("suffix"), F.col("x.s")).alias("suffix"))
    found = answers.agg(F.min("longest").alias("longest"))
    return sequences.join(found, ["variant_id", "alt", "prefix", "suffix"]).withColumn("into", F.col("longest.into")).drop("longest")


def overlapping_pairs(sequences: DataFrame) -> DataFrame:
    """Pairs (a, b, a before b) of a variant's sequences that agree where they overlap, in ``least`` nucleotides or more.

    Columns of ``sequences``: variant_id, at (its place), prefix, alt, suffix, support, least. The overlap has the shorter
    of both prefixes and of both suffixes. Either one sequence gives each, and then that half is all of its own; or one
    gives both, and then it lies within the other. So both meet in that overlap as a key.
    """
    p, s = F.length("prefix"), F.length("suffix")
    known = sequences.groupBy("variant_id").agg(F.collect_set(p).alias("ps"), F.collect_set(s).alias("ss"), F.collect_set(F.struct(p.alias("p"), s.alias("s"))).alias("shapes"))
    rows = sequences.join(known, "variant_id")

    def cut(shapes: Column, side: str) -> DataFrame:
        whole = F.struct("at", "prefix", "suffix", "support").alias(side)
        each = rows.select("variant_id", "alt", "prefix", "suffix", "least", whole, F.explode(shapes).alias("x")).where(
            F.col("x.p") + F.length("alt") + F.col("x.s") >= F.greatest(F.lit(1), F.col("least"))
        )
        return each.select("variant_id", "alt", right_part(F.col("prefix"), F.col("x.p")).alias("kp"), left_part(F.col("suffix"), F.col("x.s")).alias("ks"), side)

    pair = lambda x, y: F.struct(x.cast("int").alias("p"), y.cast("int").alias("s"))
    key = ["variant_id", "alt", "kp", "ks"]
    upto = lambda c, n: F.filter(c, lambda x: x <= n)
    crossed = cut(F.transform(upto("ss", s), lambda x: pair(p, x)), "one").join(cut(F.transform(upto("ps", p), lambda x: pair(x, s)), "two"), key)
    within = cut(F.array(pair(p, s)), "one").join(cut(F.filter("shapes", lambda x: (x["p"] < p) & (x["s"] < s)), "two"), key)
    # Two of equal text meet in both directions.
    found = crossed.unionByName(within).where("one.at <> two.at AND (one.at < two.at OR one.prefix <> two.prefix OR one.suffix <> two.suffix)")
    first = F.col("one.at") < F.col("two.at")
    longer = lambda c: F.when(F.length(f"one.{c}") >= F.length(f"two.{c}"), F.col(f"one.{c}")).otherwise(F.col(f"two.{c}"))
    return found.select(
        "variant_id",
        F.when(first, F.col("one.at")).otherwise(F.col("two.at")).alias("a"),
        F.when(first, F.col("two.at")).otherwise(F.col("one.at")).alias("b"),
        (F.length("kp") + F.length("alt") + F.length("ks")).alias("shared"),
        (F.col("one.support") + F.col("two.support")).alias("support"),
        longer("prefix").alias("prefix"),
        "alt",
        longer("suffix").alias("suffix"),
    )


def merge_in_rounds(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``assemble`` makes of collapsed sequences, as joins: for variants with more of them than one task should hold.

    ``sequences``: variant_id, at (places from 1, longest first), seen, prefix, alt, suffix, support, least. Returns the
    sequences of the last round and (variant_id, at, seen), their members.

    In a round the greedy order takes the best pair that is left. A pair that is the best of both its sequences is taken
    by that order whatever happens elsewhere, so all such pairs are taken at once, and again among the sequences that are
    left. Every step is a table in the shared folder.
    """
    current = stage_table(sequences.drop("seen"), "merge-sequences")
    members = stage_table(sequences.select("variant_id", "at", "seen"), "merge-members")
    order = F.struct((-F.col("shared")).alias("s"), (-F.col("support")).alias("n"), "a", "b").alias("order")
    while True:
        pairs = stage_table(overlapping_pairs(current).select("*", order), "merge-pairs")
        if not pairs.limit(1).count():
            return current, members
        taken = []
        while pairs.limit(1).count():
            ends = pairs.select("variant_id", F.explode(F.array("a", "b")).alias("at"), "order")
            best = ends.groupBy("variant_id", "at").agg(F.min("order").alias("best"))
            of = lambda side: best.select("variant_id", F.col("at").alias(side), F.col("best").alias(f"best_{side}"))
            chosen = pairs.join(of("a"), ["variant_id", "a"]).join(of("b"), ["variant_id", "b"]).where("order = best_a AND order = best_b").drop("best_a", "best_b")
            taken.append(stage_table(chosen, "merge-chosen"))
            gone = stage_table(taken[-1].select("variant_id", F.explode(F.array("a", "b")).alias("at")), "merge-gone")
            left = pairs
            for side in ("a", "b"):
                left = left.join(gone.withColumnRenamed("at", side), ["variant_id", side], "left_anti")
            pairs = stage_table(left, "merge-pairs")
        every = reduce(DataFrame.unionByName, taken)
        made = every.groupBy("variant_id", "prefix", "alt", "suffix").agg(
            F.min("order").alias("order"), F.sum("support").alias("support"), F.flatten(F.collect_list(F.array("a", "b"))).alias("from")
        )
        used = every.select("variant_id", F.explode(F.array("a", "b")).alias("at"))
        free = current.join(used, ["variant_id", "at"], "left_anti").select("variant_id", "prefix", "alt", "suffix", F.lit(None).cast(made.schema["order"].dataType).alias("order"), "support", F.array("at").alias("from"))
        least = current.groupBy("variant_id").agg(F.max("least").alias("least"))
        place = Window.partitionBy("variant_id").orderBy(F.asc_nulls_last("order"), F.col("from")[0])
        renewed = stage_table(made.unionByName(free).withColumn("new", F.row_number().over(place).cast("long")).join(least, "variant_id"), "merge-renewed")
        moved = renewed.select("variant_id", "new", F.explode("from").alias("at"))
        members = stage_table(members.join(moved, ["variant_id", "at"]).select("variant_id", F.col("new").alias("at"), "seen"), "merge-members")
        current = stage_table(renewed.select("variant_id", F.col("new").alias("at"), "prefix", "alt", "suffix", "support", "least"), "merge-sequences")


def assemble_groups(unique: DataFrame, least: Column, limit: int | None = MERGE_LIMIT, at_once: int = MERGE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Unique sequences of each variant assembled; ``least`` is the overlap that merging needs, ``limit`` as in ``assemble``.

    ``unique``: variant_id, prefix, alt, suffix, seen, left_reach, right_reach, n_source_reads. Returns the assembled
    sequences with the same columns, ``seen`` being their place, best first; and (variant_id, seen, place) of the
    sequences that went into each. Reads take no part: every one belongs to one distinct sequence.

    Sequences are collapsed by joins. Variants with up to ``at_once`` sequences left are merged by one task each, larger
    ones that may be merged at all by ``merge_in_rounds``.
    """
    unique = stage_table(unique, "unique-sequences")
    kind = unique.schema["variant_id"].dataType.simpleString()
    counted = unique.select("variant_id", "prefix", "alt", "suffix", "seen", reads_in(F.col("left_reach")).alias("n"), least.cast("int").alias("least"))
    owned = stage_table(with_container(counted), "collapsed-members")
    support = owned.groupBy("variant_id", F.col("into").alias("seen")).agg(F.sum("n").alias("support"))
    kept = stage_table(owned.where("into = seen").drop("into", "n").join(support, ["variant_id", "seen"]), "collapsed-sequences")
    sizes = kept.groupBy("variant_id").agg(F.count("*").alias("size"))
    small = F.col("size") <= (at_once if limit is None else min(limit, at_once))
    mergeable = F.lit(True) if limit is None else F.col("size") <= limit
    sized = kept.join(sizes, "variant_id")

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("seen").to_pylist()
        found = [Sequence(r["prefix"], r["alt"], r["suffix"], frozenset([r["seen"]])) for r in rows]
        made = assemble(found, rows[0]["least"], limit, {r["seen"]: r["support"] for r in rows})
        out = [(table["variant_id"][0], s.prefix, s.alt, s.suffix, n, member) for n, s in enumerate(made) for member in s.reads]
        names = ["variant_id", "prefix", "alt", "suffix", "place", "seen"]
        kinds = [table.schema.field("variant_id").type, *[pa.string()] * 3, pa.int64(), pa.int64()]
        return pa.table([pa.array([r[k] if k else r[k].as_py() for r in out], t) for k, t in enumerate(kinds)], names=names)

    groups = sized.where(small).select("variant_id", "prefix", "alt", "suffix", "seen", "support", "least")
    made = groups.groupBy("variant_id").applyInArrow(run, f"variant_id {kind}, prefix string, alt string, suffix string, place long, seen long")

    order = Window.partitionBy("variant_id").orderBy(F.desc(F.length("prefix") + F.length("alt") + F.length("suffix")), "seen")
    large = sized.where(~small).withColumn("at", F.row_number().over(order).cast("long"))
    best = Window.partitionBy("variant_id").orderBy(F.desc("support"), "at")
    placed = lambda df: df.withColumn("place", (F.row_number().over(best) - 1).cast("long"))
    columns = ["variant_id", "prefix", "alt", "suffix", "place", "seen"]
    made = made.unionByName(placed(large.where(~mergeable)).select(columns))
    merging = large.where(mergeable)
    if merging.limit(1).count():
        merged, of = merge_in_rounds(merging.drop("size"))
        made = made.unionByName(placed(merged).join(of, ["variant_id", "at"]).select(columns))

    # From the collapsed sequences back to the distinct ones.
    spread = made.withColumnRenamed("seen", "into").join(owned.select("variant_id", "into", "seen"), ["variant_id", "into"]).drop("into")
    spread = stage_table(spread, "assembled-members")
    whole = added_up(spread.join(unique.drop("prefix", "alt", "suffix"), ["variant_id", "seen"]), ["variant_id", "prefix", "alt", "suffix", "place"])
    return whole.withColumnRenamed("place", "seen"), spread.select("variant_id", "seen", "place")


def read_lengths(reads: Column, side: str) -> Column:
    """Lengths of the reads' unclipped prefixes or suffixes, longest first."""
    return F.sort_array(F.transform(reads, lambda r: F.length(r[side])), asc=False)


def min_coverage(prefix: Column, suffix: Column, reads: Column) -> Column:
    """Fewest reads over any position: reads all span the variant, so the ends decide."""
    over = lambda side, n: F.size(F.filter(reads, lambda r: F.length(r[side]) >= n))
    return F.least(over("prefix", F.length(prefix)), over("suffix", F.length(suffix)))


def mean_coverage(prefix: Column, alt: Column, suffix: Column, reads: Column) -> Column:
    summed = lambda side, n: F.aggregate(reads, F.lit(0), lambda s, r: s + F.least(F.length(r[side]), n))
    bases = F.size(reads) * F.length(alt) + summed("prefix", F.length(prefix)) + summed("suffix", F.length(suffix))
    return bases / (F.length(prefix) + F.length(alt) + F.length(suffix))


def trim_by_reach(prefix: Column, alt: Column, suffix: Column, left: Column, right: Column, k: Column) -> Column:
    """Struct (prefix, alt, suffix) of the positions that ``k`` reads or more cover; all empty if the variant has fewer."""
    enough = reads_in(left) >= k
    k = F.greatest(k, F.lit(1))
    reach = lambda side: F.coalesce(kth_longest(side, k), F.lit(0))
    return F.struct(
        F.when(enough, right_part(prefix, reach(left))).otherwise("").alias("prefix"),
        F.when(enough, alt).otherwise("").alias("alt"),
        F.when(enough, left_part(suffix, reach(right))).otherwise("").alias("suffix"),
    )


def trim_by_coverage(prefix: Column, alt: Column, suffix: Column, reads: Column, k: Column) -> Column:
    """``trim_by_reach`` of a list of reads."""
    enough = F.size(reads) >= k
    reach = lambda side: F.coalesce(F.get(read_lengths(reads, side), k - 1), F.lit(0))
    k = F.greatest(k, F.lit(1))
    return F.struct(
        F.when(enough, right_part(prefix, reach("prefix"))).otherwise("").alias("prefix"),
        F.when(enough, alt).otherwise("").alias("alt"),
        F.when(enough, left_part(suffix, reach("suffix"))).otherwise("").alias("suffix"),
    )


def trim_and_collapse(sequences: DataFrame, coverage: int) -> tuple[DataFrame, DataFrame]:
    """Sequences trimmed to a coverage; those that a longer trimmed one contains give it their reads.

    Returns the sequences left, with the columns of ``unique`` (see ``assemble_groups``), and (variant_id, seen, into)
    of all.
    """
    t = sequences.withColumn("_t", trim_by_reach(*(F.col(c) for c in ("prefix", "alt", "suffix", "left_reach", "right_reach")), F.lit(coverage)))
    t = t.withColumns({c: F.col(f"_t.{c}") for c in ("prefix", "alt", "suffix")}).drop("_t")
    # Containment is transitive: the longest container is itself contained in none.
    owned = stage_table(with_container(t), "trimmed-sequences")
    whole = added_up(owned.select("variant_id", F.col("into").alias("seen"), "left_reach", "right_reach", "n_source_reads"), ["variant_id", "seen"])
    left = owned.where("into = seen").select("variant_id", "seen", "prefix", "alt", "suffix").join(whole, ["variant_id", "seen"])
    return left, owned.select("variant_id", "seen", "into")


def keep_long_enough(sequences: DataFrame, preferred: int) -> DataFrame:
    """Sequences as long as the longest of their variant, or as ``preferred`` where that is less."""
    length = F.length("prefix") + F.length("alt") + F.length("suffix")
    longest = F.max(length).over(Window.partitionBy("variant_id"))
    return sequences.withColumn("_least", F.least(longest, F.lit(preferred))).where(length >= F.col("_least")).drop("_least")


def with_support(sequences: DataFrame, coverage: int) -> DataFrame:
    """Only sequences whose every position has ``coverage`` reads."""
    return sequences.where(F.least(covering(F.col("left_reach"), F.length("prefix")), covering(F.col("right_reach"), F.length("suffix"))) >= coverage)


@dataclass(frozen=True)
class SequenceOptions:
    """How sequences are built: length around the variant, coverage, and whether overlaps are merged.

    Variants with more than ``merge_limit`` sequences after collapsing are not merged; None merges all.
    """

    length: int = 90
    coverage: int = 2
    assembly: bool = False
    min_overlap: int = 30
    merge_limit: int | None = MERGE_LIMIT


def sequences_with_reads(alt_reads: DataFrame, options: SequenceOptions = SequenceOptions()) -> tuple[DataFrame, DataFrame]:
    """Sequences of each variant from its alt reads, and the reads of each.

    Sequences: variant_id, seq_rank (most reads first), prefix, alt, suffix, sequence, n_reads, n_source_reads (with
    multiplicity), left_reach, right_reach (see ``functions.reach``). Reads: variant_id, seq_rank, prefix, allele, suffix,
    name, source_read_count; each distinct read once. The odd nucleotide of the surroundings goes before the variant.
    Alleles longer than ``length`` are an error.

    Neither has more in a row than a sequence or a read: a locus of any depth is spread over all tasks.
    """
    rows = modal_allele(alt_reads)
    around = F.lit(options.length) - F.length("allele")
    around = F.when(around >= 0, around).otherwise(F.raise_error(F.lit("the allele is longer than the sequence length")))
    after = F.floor(around / 2).cast("int")
    reads = stage_table(distinct_reads(rows, around - after, after), "sequence-reads")
    keys = ["variant_id", "p", "alt", "s"]
    unique = tallied(reads.withColumnRenamed("allele", "alt"), keys, F.lit(1), F.col("read_ordinal"), F.col("source_read_count"), F.length("prefix"), F.length("suffix"))
    unique = stage_table(unique, "distinct-sequences")
    # Which sequence a distinct one ends in, step by step.
    ends_in = unique.select(*keys, "seen")
    current = unique.withColumnsRenamed({"p": "prefix", "s": "suffix"})
    if options.assembly:
        current, members = assemble_groups(current, F.least(F.lit(options.min_overlap), F.floor((options.length - F.length("alt")) / 2)), options.merge_limit)
        ends_in = ends_in.join(members, ["variant_id", "seen"]).drop("seen").withColumnRenamed("place", "seen")
    current, into = trim_and_collapse(current, options.coverage)
    ends_in = ends_in.join(into, ["variant_id", "seen"]).drop("seen").withColumnRenamed("into", "seen")
    order = Window.partitionBy("variant_id").orderBy(F.desc("n_reads"), "seen")
    kept = keep_long_enough(current, options.length).withColumn("n_reads", reads_in(F.col("left_reach")))
    kept = stage_table(kept.withColumn("seq_rank", F.row_number().over(order)), "ranked-sequences")
    ends_in = ends_in.join(kept.select("variant_id", "seen", "seq_rank"), ["variant_id", "seen"]).drop("seen").withColumnRenamed("alt", "allele")
    columns = ["variant_id", "seq_rank", "prefix", "alt", "suffix", F.concat("prefix", "alt", "suffix").alias("sequence"), "n_reads", "n_source_reads", "left_reach", "right_reach"]
    return kept.select(*columns), reads.join(ends_in, ["variant_id", "p", "allele", "s"]).select("variant_id", "seq_rank", *READ)


def variant_sequences(alt_reads: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """The sequences of ``sequences_with_reads``."""
    return sequences_with_reads(alt_reads, options)[0]


__all__ = ["Sequence", "SequenceOptions", "assemble", "collapse", "unique_sequences", "variant_sequences"]
