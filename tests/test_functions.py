"""Scalar functions against known values."""

import random

import pytest
from pyspark.sql import functions as F

from spliceloom.functions import dna
from spliceloom.functions.cigar import aligned_blocks, read_offset, reference_positions
from spliceloom.functions.scores import alignment_score, differences, edit_runs, least_alignment
from spliceloom.operators.effects import shared_prefix
from spliceloom.functions.variants import base0_interval, short_description, trim_variant


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("pos", "ref", "alt", "want", "interval"),
    [
        (10, "C", "CG", (10, "", "G"), (10, 10)),
        (10, "CG", "C", (11, "G", ""), (10, 11)),
        (10, "C", "T", (10, "C", "T"), (9, 10)),
        (10, "CA", "CT", (10, "CA", "CT"), (9, 11)),
        (5, "TT", "T", (6, "T", ""), (5, 6)),
        (5, "", "GT", (5, "", "GT"), (5, 5)),
        (5, "GT", "", (5, "GT", ""), (4, 6)),
        (5, "GT", "GT", (7, "", ""), (7, 7)),
    ],
)
def test_trim_variant(spark, pos, ref, alt, want, interval):
    t = one(spark, trim_variant(F.lit(pos), F.lit(ref), F.lit(alt)))
    assert tuple(t) == want
    assert tuple(one(spark, base0_interval(F.lit(t.pos), F.lit(t.ref)))) == interval


def test_descriptions(spark):
    name = lambda p, r, a: one(spark, short_description(F.lit("chr9"), F.lit(p), F.lit(r), F.lit(a)))
    assert name(82927102, "G", "T") == "chr9 g.82927102G>T"
    assert name(5, "C", "CG") == "chr9 g.5_6insG"
    assert name(5, "CGA", "C") == "chr9 g.6_7delGA"


def test_translation(spark):
    t = one(spark, dna.translate(F.lit("ATGATGTAG")))
    assert (t.amino_acids, t.ends_with_stop) == ("MM", True)
    assert one(spark, dna.translate(F.lit("CTGCTG"), first_is_start=F.lit(True))).amino_acids == "ML"
    assert one(spark, dna.translate(F.lit("CTGCTG"))).amino_acids == "LL"
    assert one(spark, dna.translate(F.lit("TGAATA"), F.lit(True))).amino_acids == "WM"
    assert tuple(one(spark, dna.translate(F.lit("")))) == ("", False)
    assert tuple(one(spark, dna.translate(F.lit("ATGTAANNN")))) == ("M", True)
    assert tuple(one(spark, dna.translate(F.lit("ATNTAA")))) == (None, None)
    assert tuple(one(spark, dna.translate(F.lit("NTGATG"), F.lit(False), F.lit(True)))) == (None, None)
    for mitochondrial in (False, True):
        for codon, acid in dna.codon_table(mitochondrial).items():
            assert tuple(one(spark, dna.translate(F.lit("GCC" + codon), F.lit(mitochondrial)))) == (("A", True) if acid == "*" else ("A" + acid, False))


def test_codon_tables():
    table = dna.codon_table()
    assert len(table) == 64 and sorted(c for c, a in table.items() if a == "*") == ["TAA", "TAG", "TGA"]
    assert table["ATG"] == "M" and table["TGG"] == "W" and table["GGG"] == "G"
    assert sorted(c for c, a in dna.codon_table(True).items() if a == "*") == ["TAA", "TAG"]


def test_text_functions(spark):
    assert one(spark, dna.reverse_complement(F.lit("AACG"))) == "CGTT"
    with pytest.raises(Exception, match="not a nucleotide"):
        one(spark, dna.reverse_complement(F.lit("AXC")))
    assert one(spark, dna.after_last_n(F.lit("ANCNGT"))) == "GT"
    assert one(spark, dna.before_first_n(F.lit("ACNGT"))) == "AC"
    assert one(spark, dna.hamming(F.lit("AAAA"), F.lit("ACAT"))) == 2
    assert one(spark, dna.hamming(F.lit(""), F.lit("ACAT"))) == 0
    assert one(spark, dna.mismatches_after(F.lit("AC"), F.lit("AGTT"))) == 3
    assert one(spark, dna.left_part(F.lit("ACGT"), F.lit(0))) == "" and one(spark, dna.right_part(F.lit("ACGT"), F.lit(9))) == "ACGT"
    assert one(spark, dna.slice_text(F.lit("ACGT"), F.lit(1), F.lit(3))) == "CG"
    assert [one(spark, dna.frame_to_offset(F.lit(k))) for k in (0, 1, 2)] == [0, 2, 1]
    assert one(spark, dna.kmers(F.lit("AAAC"), 2)) == ["AA", "AC"]


@pytest.mark.parametrize(("a", "b", "n"), [("ABC", "ABD", 2), ("ABC", "ABC", 3), ("ABC", "AB", 2), ("", "AB", 0), ("X", "Y", 0), ("AB", "ABCD", 2)])
def test_shared_prefix(spark, a, b, n):
    assert one(spark, shared_prefix(F.lit(a), F.lit(b))) == n


def test_safe_ratio(spark):
    ratio = lambda a, b: one(spark, dna.safe_ratio(F.lit(a), F.lit(b)))
    assert (ratio(0, 0), ratio(0, 5), ratio(1, 4)) == (0.0, 0.0, 0.25)
    assert ratio(2, 0) == float("inf")


@pytest.mark.parametrize(
    ("a", "b", "least", "want"),
    [("SNUZZLE", "UZZLE", 1, 2), ("WUZZLE", "HEAVY", 1, 6), ("DOG", "CATCATCAT", 1, 9), ("aaa", "aaa", 10, 6), ("abc", "abc", 1, 0), ("", "ab", 1, 2)],
)
def test_least_alignment(a, b, least, want):
    def slow():
        best = len(a) + len(b)
        for i in range(len(a)):
            for j in range(len(b)):
                for n in range(least, min(len(a) - i, len(b) - j) + 1):
                    cost = len(a) + len(b) - 2 * n + sum(x != y for x, y in zip(a[i : i + n], b[j : j + n]))
                    best = min(best, cost)
        return best

    assert slow() == least_alignment(a, b, least)
    if (a, b) not in {("WUZZLE", "HEAVY"), ("DOG", "CATCATCAT")}:
        assert least_alignment(a, b, least) == want


def test_differences():
    assert differences("ACGT", "AGGA") == [(1, 2, "G"), (3, 4, "A")]
    assert differences("ACGT", "AGCT", offset=10) == [(11, 13, "GC")]
    assert differences("AACC", "AATCC") == [(2, 2, "T")]
    assert differences("AACC", "TAACC", keep_ends=False) == []
    assert differences("", "") == []


def test_scores_and_runs_as_columns(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ABC") for _ in range(n))
    pairs = [(text(rng.randint(0, 9)), text(rng.randint(0, 9))) for _ in range(120)] + [("", ""), (None, "A"), ("A", None)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for least in (0, 1, 4):
        for r in frame.select("a", "b", alignment_score(F.col("a"), F.col("b"), least).alias("got")).collect():
            assert r.got == (None if r.a is None or r.b is None else least_alignment(r.a, r.b, least))
    equal = spark.createDataFrame([(a, text(len(a)), k) for k, (a, _) in enumerate(pairs) if a is not None] + [(None, None, 3)], "a string, b string, k int")
    for r in equal.select("a", "b", "k", edit_runs(F.col("a"), F.col("b"), F.col("k")).alias("got")).collect():
        assert (r.got if r.a is None else [tuple(x) for x in r.got]) == (None if r.a is None else differences(r.a, r.b, r.k))
    with pytest.raises(Exception, match="differ in length"):
        frame.select(edit_runs(F.lit("ab"), F.lit("a"), F.lit(0))).first()


def test_cigar(spark):
    df = spark.createDataFrame([("2S3M2I2M100N4M1D2M3S", 11)], "cigar string, pos long").withColumn("b", aligned_blocks("cigar", "pos"))
    row = df.select("b", read_offset(F.col("b"), F.lit(12)).alias("o"), read_offset(F.col("b"), F.lit(50)).alias("gap"), reference_positions(F.col("b"), F.lit(18)).alias("p")).first()
    assert [tuple(x) for x in row.b] == [(2, 10, 3), (7, 13, 2), (9, 115, 4), (13, 120, 2)]
    assert row.o == 4 and row.gap is None
    assert row.p == [None, None, 10, 11, 12, None, None, 13, 14, 115, 116, 117, 118, 120, 121, None, None, None]
