"""Steps that decide how queries grow: what is done once, and what is sent where."""

import random

import pytest
from pyspark.sql import functions as F

from spliceloom import queries
from spliceloom.operators import mates, reads
from spliceloom.plans.scratch import stage_table

TEXTS = ["Acgt gaTTaca", "", None, "xyz\nNNAéC\r\ncg T", "AAAA", "\U0001f9ecGCİt"]


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(k, t, "en", "s") for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_letters_of_a_text_are_taken_out_once(spark, documents):
    dna = queries._dna(spark, documents)
    got = {r.doc_id: r.dna for r in dna.collect()}
    assert got == {k: t if t is None else "".join(c for c in t.upper() if c in "ACGT") for k, t in enumerate(TEXTS)}
    cut = dna.where("length(dna) >= 2").selectExpr("doc_id", "substr(dna, 1, length(dna) div 2) AS p", "substr(dna, length(dna) div 2 + 1) AS s")
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def _alignments(spark, n, parts):
    rows = [(k, f"r{k}", 0, "1", 1 + k % 7, 60, "6M2I6M" if k % 3 else "5M3D4M9N5M", "ACGTACGTACGTAC", "I" * 14, None) for k in range(n)]
    kinds = "read_ordinal long, qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, md string"
    return spark.createDataFrame(rows, kinds).repartition(parts)


def test_reads_of_one_locus_stay_spread(spark, monkeypatch):
    variants = spark.createDataFrame([(f"v{p}", "chr1", p, "A", "C") for p in (4, 9, 15)], "variant_id string, contig string, pos long, ref string, alt string")
    alignments = stage_table(_alignments(spark, 60, 6), "test-alignments")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        found = reads.locus_reads(variants, alignments)
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        few = sorted(map(str, found.collect()))
        monkeypatch.setattr(reads, "FEW_LOCI", 0)
        assert len(few) > 100 and sorted(map(str, reads.locus_reads(variants, alignments).collect())) == few
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bases_of_mates_are_laid_out_once(spark):
    row = lambda k, at: ("v", k, "a" if k < 2 else f"b{k // 2}", "ACGTA", list(range(at, at + 5)), [30] * 5, 1, 3, 4, 3 - at, 4 - at)
    kinds = "variant_id string, read_ordinal long, name string, sequence string, reference_positions array<bigint>, quality_scores array<int>, source_read_count long, reference_base0_start long, reference_base0_end long, read_base0_start long, read_base0_end long"
    # The second of the first pair agrees; those of the other differ in bases of equal quality.
    pairs = spark.createDataFrame([row(0, 0), row(1, 0), row(2, 0), row(3, 1)], kinds)
    made = mates.merge_pairs(pairs)
    assert sorted((r.name, r.read_ordinal, r.sequence, r.source_read_count) for r in made.collect()) == [("a", 0, "ACGTA", 2), ("b1", 2, "ACGTA", 1), ("b1", 3, "ACGTA", 1)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def _sent(df):
    """Rows that a plan's shuffles sent."""

    def walk(node):
        metric = node.metrics().get("shuffleRecordsWritten")
        inner = [node.children().apply(k) for k in range(node.children().size())]
        return (metric.get().value() if metric.isDefined() else 0) + sum(map(walk, inner))

    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return walk(plan)


def test_intervals_of_the_larger_side_are_sent_once(spark):
    rng = random.Random(7)
    lengths = (-1, 0, 1, 2, 5, 6, 9, 10, 11, 19, 20, 21, 39, 40, 41, 300)
    spans = lambda n: [(k, rng.choice("ab"), s, s + rng.choice(lengths)) for k in range(n) for s in [rng.randrange(-60, 200)]]
    left, right = [*spans(150), (998, None, 0, 9), (999, "a", None, 9)], [*spans(60), (998, None, 0, 9), (999, "a", 0, None)]
    a, b = spark.createDataFrame(left, "i long, k string, s long, e long"), spark.createDataFrame(right, "j long, rk string, rs long, re long")
    met = lambda x, y: None not in x[1:] + y[1:] and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]) and x[2] < x[3] and y[2] < y[3]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        found = reads.interval_join(a, b, ("k", "s", "e"), ("rk", "rs", "re"), 10)
        assert found.columns == ["i", "k", "s", "e", "j", "rk", "rs", "re"]
        assert sorted((r.i, r.j) for r in found.collect()) == sorted((x[0], y[0]) for x in left for y in right if met(x, y))
        # Of 30 wide ones in bins of 10, 500 go once; a place goes to two bins.
        many = spark.range(500).selectExpr("id AS i", "'a' AS k", "id AS s", "id + 30 AS e")
        places = spark.range(20).selectExpr("id AS j", "'a' AS rk", "id AS rs", "id + 1 AS re")
        assert _sent(reads.interval_join(many, places, ("k", "s", "e"), ("rk", "rs", "re"), 10)) == 540
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_translations_are_listed_only_where_they_are_shown(spark, tmp_path):
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(k, k % 2, k % 3, k, 2.0, "A", "F") for k in range(6)], kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    made = queries.protein_ranking(spark, str(tmp_path))
    assert sorted((r.variant_id, r.num_supporting_fragments, r.n_transcripts) for r in made.collect()) == [(0, 3, 3), (1, 3, 3)]
    assert "translations" not in made._jdf.queryExecution().optimizedPlan().toString()
