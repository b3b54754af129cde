"""Containment and greedy merging by joins against the plain functions."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spliceloom.functions.reach import bases_within, covering, kth_longest, reach_of, reads_in
from spliceloom.operators.assembly import Sequence, SequenceOptions, assemble, assemble_groups, sequences_with_reads, trim_and_collapse, variant_sequences, with_container
from spliceloom.operators.phasing import shared_names

READ = "array<struct<prefix:string,allele:string,suffix:string,name:string,source_read_count:bigint>>"
SCHEMA = f"variant_id long, prefix string, alt string, suffix string, reads {READ}, seen long"


def random_groups(seed, variants, size, spread=30):
    """Fragments of two made-up haplotypes around each variant, some with an error; distinct in a variant."""
    rng = random.Random(seed)
    rows, seen = [], 0
    for v in range(variants):
        haplotypes = []
        base = [rng.choice("ACGT") for _ in range(2 * spread)]
        for _ in range(2):
            h = list(base)
            h[rng.randrange(2 * spread)] = rng.choice("ACGT")
            haplotypes.append("".join(h))
        found = set()
        for _ in range(size):
            h = rng.choice(haplotypes)
            p, s = h[spread - rng.randint(0, spread) : spread], h[spread : spread + rng.randint(0, spread)]
            if rng.random() < 0.2 and p:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("ACGT") + p[k + 1 :]
            found.add((p, rng.choice(["A", "A", "A", ""]), s))
        for p, a, s in sorted(found, key=lambda x: rng.random()):
            seen += 1
            n = rng.choice([1, 1, 2, 5])
            rows.append((v, p, a, s, [(p, a, s, f"r{seen}-{k}", 1) for k in range(n)], seen))
    return rows


def sequences_of(rows, v):
    return [Sequence(p, a, s, frozenset([seen])) for v_, p, a, s, _, seen in sorted(rows, key=lambda r: r[5]) if v_ == v]


def test_containers(spark):
    rows = random_groups(1, 12, 60) + [(99, "", "", "", [], 1), (98, "", "", "", [], 1), (98, "", "", "", [], 2), (98, "A", "", "", [], 3)]
    got = {(r.variant_id, r.seen): r.into for r in with_container(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for v, p, a, s, _, seen in rows:
        over = [(-len(x[1]) - len(x[3]), x[5]) for x in rows if x[0] == v and x[2] == a and x[1].endswith(p) and x[3].startswith(s)]
        assert got[v, seen] == min(over)[1]


def tables(spark, rows):
    """Sequences with histograms instead of their lists of reads."""
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("variant_id", "prefix", "alt", "suffix", "seen", reach_of(F.col("reads"), "prefix").alias("left_reach"), reach_of(F.col("reads"), "suffix").alias("right_reach"), F.size("reads").cast("long").alias("n_source_reads"))


def reach_by_hand(reads, side):
    counted = Counter(len(r[side]) for r in reads)
    return sorted(counted.items(), reverse=True)


@pytest.mark.parametrize(("limit", "at_once"), [(None, 0), (None, 6), (25, 0), (25, 1000)])
def test_groups_are_assembled_alike_by_tasks_and_by_joins(spark, limit, at_once):
    rows = random_groups(3, 5, 45) + [(50, *r[1:]) for r in random_groups(4, 1, 3)]
    made, members = (x.collect() for x in assemble_groups(tables(spark, rows), F.lit(8), limit, at_once))
    for v in {r[0] for r in rows}:
        mine = {r[5]: r[4] for r in rows if r[0] == v}
        want = assemble(sequences_of(rows, v), 8, limit, {k: len(x) for k, x in mine.items()})
        got = sorted((r for r in made if r.variant_id == v), key=lambda r: r.seen)
        assert [(r.prefix, r.alt, r.suffix) for r in got] == [(s.prefix, s.alt, s.suffix) for s in want]
        assert {(r.place, r.seen) for r in members if r.variant_id == v} == {(n, k) for n, s in enumerate(want) for k in s.reads}
        for r, s in zip(got, want, strict=True):
            reads = [x for k in s.reads for x in mine[k]]
            assert r.n_source_reads == len(reads)
            assert [[tuple(x) for x in h] for h in (r.left_reach, r.right_reach)] == [reach_by_hand(reads, 0), reach_by_hand(reads, 2)]


def test_merging_takes_several_rounds(spark):
    """Tiles of one long text merge pairwise until one is left."""
    rng = random.Random(8)
    text = "".join(rng.choice("ACGT") for _ in range(200))
    rows = [(1, text[40 + k : 100], "", text[100 : 130 + 2 * k], [(text[40 + k : 100], "", text[100 : 130 + 2 * k], f"n{k}", 1)], k + 1) for k in range(12)]
    made, members = assemble_groups(tables(spark, rows), F.lit(30), None, 0)
    assert [(r.prefix, r.suffix, r.n_source_reads) for r in made.collect()] == [(text[40:100], text[100:152], 12)]
    assert members.count() == 12


def test_collapsed_reads_go_to_the_longest(spark):
    rows = random_groups(5, 6, 50)
    kept, into = (x.collect() for x in trim_and_collapse(tables(spark, rows), 1))
    for v in {r[0] for r in rows}:
        want = assemble(sequences_of(rows, v), 10**6, 0)
        assert {(r.prefix, r.alt, r.suffix, r.seen) for r in kept if r.variant_id == v} == {(s.prefix, s.alt, s.suffix, next(r[5] for r in rows if r[:4] == (v, s.prefix, s.alt, s.suffix))) for s in want}
        sizes = {r[5]: len(r[4]) for r in rows if r[0] == v}
        seen = {(r.prefix, r.alt, r.suffix): r for r in kept if r.variant_id == v}
        for s in want:
            r = seen[s.prefix, s.alt, s.suffix]
            assert {x.seen for x in into if x.variant_id == v and x.into == r.seen} == set(s.reads)
            assert r.n_source_reads == sum(sizes[k] for k in s.reads)


@pytest.mark.parametrize("assembly", [False, True])
def test_reads_of_sequences(spark, assembly):
    """Every read is with one sequence that it agrees with; counts and histograms are those of its reads."""
    rng = random.Random(12)
    text = "".join(rng.choice("ACGT") for _ in range(80))
    rows = []
    for k in range(150):
        left, right = rng.randint(5, 40), rng.randint(5, 39)
        rows.append((k % 3, k, text[40 - left : 40], "A", text[41 : 41 + right], f"n{k // 2}", 1 + k % 2))
    rows += [(0, 1000, *rows[0][2:]), (0, 1001, *rows[3][2:])]  # repeated reads
    frame = spark.createDataFrame(rows, "variant_id long, read_ordinal long, prefix string, allele string, suffix string, name string, source_read_count long")
    sequences, reads = (x.collect() for x in sequences_with_reads(frame, SequenceOptions(length=41, coverage=2, assembly=assembly, min_overlap=10)))
    assert len(reads) == len({tuple(r) for r in reads}) and sequences
    for s in sequences:
        mine = [r for r in reads if (r.variant_id, r.seq_rank) == (s.variant_id, s.seq_rank)]
        assert len(mine) == s.n_reads and sum(r.source_read_count for r in mine) == s.n_source_reads
        assert [[tuple(x) for x in h] for h in (s.left_reach, s.right_reach)] == [reach_by_hand([(r.prefix, r.suffix) for r in mine], side) for side in (0, 1)]
        assert s.sequence == s.prefix + s.alt + s.suffix and len(s.sequence) == 41


def test_histograms(spark):
    rng = random.Random(4)
    for _ in range(5):
        reads = [("A" * rng.randint(0, 6), "C" * rng.randint(0, 6)) for _ in range(rng.randint(0, 12))]
        frame = spark.createDataFrame([(reads,)], "reads array<struct<prefix:string,suffix:string>>").withColumn("r", reach_of(F.col("reads"), "prefix"))
        lengths = sorted((len(p) for p, _ in reads), reverse=True)
        row = frame.select("r", reads_in(F.col("r")).alias("n"), *[f(F.col("r"), F.lit(k)).alias(f"{f.__name__}{k}") for f in (covering, kth_longest, bases_within) for k in range(8)]).first()
        assert row.n == len(reads) and [tuple(x) for x in row.r] == reach_by_hand(reads, 0)
        for k in range(8):
            assert row[f"covering{k}"] == sum(x >= k for x in lengths)
            assert row[f"kth_longest{k}"] == (lengths[k - 1] if 1 <= k <= len(lengths) else None)
            assert row[f"bases_within{k}"] == sum(min(x, k) for x in lengths)


def test_one_hot_variant(spark):
    """60,000 distinct sequences of one variant, ten of each of 6,000 texts: their pairs would be billions."""
    rows = (
        spark.range(60_000)
        .select(
            F.lit(1).cast("long").alias("variant_id"),
            F.substring(F.translate(F.md5(F.floor(F.col("id") / 10).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 24).alias("long"),
            F.col("id").alias("read_ordinal"),
        )
        .withColumns(
            {
                "prefix": F.expr("substring(long, cast(read_ordinal % 5 as int) + 1)"),
                "allele": F.lit("A"),
                "suffix": F.expr("substring(long, 1, 24 - cast(read_ordinal % 7 as int))"),
                "name": F.concat(F.lit("n"), F.col("read_ordinal")),
                "source_read_count": F.lit(1).cast("long"),
            }
        )
        .drop("long")
    )
    began = time.time()
    got = variant_sequences(rows, SequenceOptions(length=49, coverage=1, assembly=True))
    # The longest sequences are those of every 35th read, and hold the other nine of their text.
    assert got.agg(F.count("*"), F.sum("n_reads")).first()[:] == (1715, 17150)
    assert time.time() - began < 180


@pytest.mark.parametrize("block", [1, 3, 512])
def test_names_of_many_variants(spark, block):
    rng = random.Random(2)
    rows = [(v, f"n{rng.randrange(6)}") for v in range(40) for _ in range(3)] + [(v, "hot") for v in range(30)] + [(1, None), (2, None), (7, "alone")]
    rows += rows[:5]
    got = {(r.a, r.b): r.n for r in shared_names(spark.createDataFrame(rows, "variant_id long, name string"), block=block).collect()}
    names = {v: {n for w, n in rows if w == v and n} for v, _ in rows}
    want = {(a, b): len(names[a] & names[b]) for a in names for b in names if a < b and names[a] & names[b]}
    assert got == want
