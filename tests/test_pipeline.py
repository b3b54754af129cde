"""Contexts, frames, proteins, phasing and whole runs on a small made-up gene."""

import random

import pytest
from pyspark.sql import functions as F

from spliceloom import cli
from spliceloom.functions.dna import codon_table
from spliceloom.operators import assembly, edits, phasing, proteins, results
from spliceloom.operators.assembly import Sequence, assemble, collapse, pairs_to_try
from spliceloom.operators.contexts import reference_contexts
from spliceloom.operators.effects import top_effects, transcript_effects
from spliceloom.operators.filters import with_filters
from spliceloom.plans.pipeline import Options, Run, run
from spliceloom.sources import readers

RNG = random.Random(11)
CODONS = [c for c, a in codon_table().items() if a != "*"]
UTR5, UTR3 = "ACGTACGTAC", "GGTTGGTTGG"
CDS = "ATG" + "".join(RNG.choice(CODONS) for _ in range(60)) + "TAA"
SEQUENCE = UTR5 + CDS + UTR3
PROTEIN = "".join(codon_table()[CDS[i : i + 3]] for i in range(0, len(CDS) - 3, 3))
FLIP = str.maketrans("ACGT", "TGCA")


def reverse(s):
    return s.translate(FLIP)[::-1]


def transcript(strand):
    """Two exons of 100 and the rest with an intron of 50 between; genomic positions from 1001."""
    n = len(SEQUENCE)
    if strand == "+":
        exons = [(1001, 1100), (1151, 1150 + n - 100)]
    else:
        exons = [(1151 + n - 100, 1250 + n - 100), (1101, 1100 + n - 100)]
    name = "T" + strand
    return (name, name + "-1", "G" + strand, "gene" + strand, "chr" + ("1" if strand == "+" else "2"), strand, "protein_coding", True,
            [{"start": a, "end": b} for a, b in exons], SEQUENCE, len(UTR5), len(UTR5) + len(CDS) - 3, PROTEIN)


def genomic(strand, offset):
    """Genomic position from 1 of a transcript offset."""
    if strand == "+":
        return 1001 + offset + (50 if offset >= 100 else 0)
    n = len(SEQUENCE)
    return 1250 + n - 100 - offset if offset < 100 else 1100 + n - offset


@pytest.fixture(scope="module")
def transcripts(spark):
    return spark.createDataFrame([transcript("+"), transcript("-")], readers.TRANSCRIPT_SCHEMA).cache()


def snv(strand, offset):
    old = SEQUENCE[offset]
    new = {"A": "C", "C": "A", "G": "T", "T": "G"}[old]
    return ("1" if strand == "+" else "2", genomic(strand, offset), old if strand == "+" else reverse(old), new if strand == "+" else reverse(new)), new


def reads_over(strand, offset, new, n_alt, n_ref, first, span=40):
    """SAM-like rows of reads over an offset of the second exon."""
    rows = []
    for k in range(n_alt + n_ref):
        left, right = offset - span + k % 5, offset + span - k % 7
        text = SEQUENCE[left:offset] + (new if k < n_alt else SEQUENCE[offset]) + SEQUENCE[offset + 1 : right]
        text = text if strand == "+" else reverse(text)
        start = genomic(strand, left if strand == "+" else right - 1)
        rows.append((first + k, f"f{first + k}", 0, "chr" + ("1" if strand == "+" else "2"), start, 60, f"{len(text)}M", text, "I" * len(text), None))
    return rows


@pytest.fixture(scope="module")
def inputs(spark):
    plus, a = snv("+", 150)
    minus, b = snv("-", 160)
    near, c = snv("+", 156)
    rows = reads_over("+", 150, a, 6, 4, 0) + reads_over("-", 160, b, 5, 3, 100)
    both = list(SEQUENCE)
    both[150], both[156] = a, c
    for k in range(3):
        text = "".join(both[115 + k : 190])
        rows.append((200 + k, f"f{200 + k}", 0, "chr1", genomic("+", 115 + k), 60, f"{len(text)}M", text, "I" * len(text), None))
    variants = readers.literal_variants(spark, [plus, minus, near, ("1", 1120, "A", "C")])
    schema = "read_ordinal long, qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, md string"
    return variants.cache(), spark.createDataFrame(rows, schema).cache()


def test_contexts(inputs, transcripts):
    got = reference_contexts(inputs[0], transcripts, 30).collect()
    assert len(got) == 3
    for r in got:
        offset = 150 if r.strand == "+" and r.sequence_at_variant_locus == SEQUENCE[150] and r.sequence_before_variant_locus == SEQUENCE[120:150] else None
        offset = offset or (160 if r.strand == "-" else 156)
        assert r.sequence_before_variant_locus == SEQUENCE[offset - 30 : offset]
        assert r.sequence_after_variant_locus == SEQUENCE[offset + 1 : offset + 31]
        first = offset - 30 + r.offset_to_first_complete_codon
        assert (first - len(UTR5)) % 3 == 0
        codons = SEQUENCE[first:offset]
        assert r.amino_acids_before_variant == "".join(codon_table()[codons[i : i + 3]] for i in range(0, len(codons) // 3 * 3, 3))
        assert not r.contains_start_codon and not r.contains_five_prime_utr


def mutated(offset, new, *more):
    s = list(SEQUENCE)
    for o, b in [(offset, new), *more]:
        s[o] = b
    cds = "".join(s)[len(UTR5) : len(UTR5) + len(CDS) - 3]
    return "".join(codon_table()[cds[i : i + 3]] for i in range(0, len(cds), 3)).split("*")[0]


@pytest.mark.parametrize("assembled", [False, True])
def test_whole_run(inputs, transcripts, assembled):
    variants, alignments = inputs
    options = Options.command_line(thresholds={"min_num_alt_reads": 3}) if assembled else Options()
    rows = {r.variant: r for r in run(variants, alignments, transcripts, options).collect()}
    assert len(rows) == 4
    for strand, offset in (("+", 150), ("-", 160)):
        (contig, pos, ref, alt), new = snv(strand, offset)
        r = rows[f"{contig} g.{pos}{ref}>{alt}"]
        assert (r.num_alt_reads, r.num_ref_reads, r.num_other_reads) == ((9, 4, 0) if strand == "+" else (5, 3, 0))
        protein = r.protein_sequence
        assert protein in mutated(offset, new)
        assert r.protein_sequence_contains_mutation and r.num_cdna_mismatches_before_variant_in_top_protein_sequence == 0
        assert r.predicted_effect_mutant_protein_sequence == mutated(offset, new)
        assert r.protein_sequence_matches_predicted_mutation_effect and r.num_amino_acid_mismatches_from_predicted_effect == 0
        assert r.trimmed_predicted_mutant_protein_sequence == protein and r.trimmed_reference_protein_sequence in PROTEIN
        assert r.passes_all_filters and r.top_gene_name == "gene" + strand
    near = next(r for r in rows.values() if r.num_alt_reads == 3)
    assert near.num_phased_variants_from_reads == 1 and near.num_protein_sequences == 1
    off = next(r for r in rows.values() if r.num_total_reads == 0)
    assert not off.passes_all_filters and off.protein_sequence is None and off.num_reads_supporting_top_protein_sequence == 0
    assert off.protein_sequence_matches_predicted_mutation_effect is None and off.predicted_effect_class == "Intronic"


def test_effects(spark, transcripts):
    at = len(UTR5) + 30
    change = lambda ref, alt: ("1", genomic("+", at), ref, alt)
    stop = next(k for k in range(at, at + 90, 3) if SEQUENCE[k : k + 3] not in ("TAA",))
    cases = {
        change(SEQUENCE[at], SEQUENCE[at] + "G"): "FrameShift",
        change(SEQUENCE[at : at + 4], SEQUENCE[at]): "Deletion",
        ("1", genomic("+", stop), SEQUENCE[stop : stop + 3], "TAA"): "PrematureStop",
        ("1", genomic("+", 3), SEQUENCE[3], {"A": "C"}.get(SEQUENCE[3], "A")): "FivePrimeUTR",
        ("1", 1120, "A", "C"): "Intronic",
        ("1", 5, "A", "C"): "Intergenic",
        ("1", genomic("+", len(UTR5)), "ATG", "CCC"): "StartLoss",
    }
    variants = readers.literal_variants(spark, cases)
    got = top_effects(variants, transcript_effects(variants, transcripts)).join(variants, "variant_id").collect()
    assert {(r.contig, r.pos, r.ref, r.alt): r.effect_class for r in got} == cases


def test_assembly():
    s = lambda p, a, t, *r: Sequence(p, a, t, frozenset(r))
    a, b, c = s("AACC", "G", "TT", 1), s("CC", "G", "TTAA", 2), s("C", "G", "T", 3)
    assert a.contains(c) and not a.contains(b)
    assert a.joined(b, 5) == b.joined(a, 5) == (5, s("AACC", "G", "TTAA", 1, 2)) and a.joined(b, 6) is None
    assert a.joined(c, 3) == (3, s("AACC", "G", "TT", 1, 3)) and a.joined(s("AACC", "T", "TT"), 1) is None
    assert collapse([c, a, b]) == [s("AACC", "G", "TT", 1, 3), b]
    assert assemble([a, b, c], 5) == [s("AACC", "G", "TTAA", 1, 2, 3)]
    rng = random.Random(3)
    contig = "".join(rng.choice("ACGT") for _ in range(54))
    nested = [s(contig[i:27], contig[27], contig[28 : 28 + j], i * 20 + j) for i in range(20) for j in range(20)]
    want = assemble(nested, 10)
    assert [x.text for x in want] == [contig[0:47]]
    for _ in range(3):
        rng.shuffle(nested)
        assert assemble(nested, 10) == want
    unrelated = [s(x * 5, "G", y * 5, 0) for x, y in ("AC", "CA", "TT", "GG")]
    assert pairs_to_try(unrelated, 11) == []


def test_merge_limit_can_be_lifted(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    many = [Sequence(dna(20), "G", dna(20), frozenset([k])) for k in range(1000)]
    pair = [Sequence("A" * 20, "G", "C" * 12, frozenset([1000])), Sequence("A" * 12, "G", "C" * 20, frozenset([1001]))]
    whole = ("A" * 20, "G", "C" * 20)
    assert whole not in {(x.prefix, x.alt, x.suffix) for x in assemble(many + pair, 25)}
    assert whole in {(x.prefix, x.alt, x.suffix) for x in assemble(many + pair, 25, None)}

    rows = [("v", k, x.prefix, x.alt, x.suffix, str(k), 1) for k, x in enumerate(pair)]
    reads = spark.createDataFrame(rows, "variant_id string, read_ordinal long, prefix string, allele string, suffix string, name string, source_read_count long")
    made = {
        limit: {r.sequence for r in assembly.variant_sequences(reads, assembly.SequenceOptions(length=41, coverage=1, assembly=True, min_overlap=15, merge_limit=limit)).collect()}
        for limit in (1, None)
    }
    assert made == {1: {"".join((x.prefix, x.alt, x.suffix)) for x in pair}, None: {"".join(whole)}}


def test_coverage(spark):
    reads = [("AA", "TT"), ("AA", "T"), ("A", "TT")]
    frame = spark.createDataFrame([([{"prefix": p, "suffix": s} for p, s in reads],)], "reads array<struct<prefix:string,suffix:string>>")
    p, a, s, r = F.lit("AA"), F.lit("C"), F.lit("TT"), F.col("reads")
    got = frame.select(assembly.min_coverage(p, s, r).alias("min"), assembly.mean_coverage(p, a, s, r).alias("mean"), assembly.trim_by_coverage(p, a, s, r, F.lit(3)).alias("t")).first()
    assert (got["min"], got["mean"]) == (2, 13 / 5) and tuple(got.t) == ("A", "C", "T")
    assert tuple(frame.select(assembly.trim_by_coverage(p, a, s, r, F.lit(4)).alias("t")).first().t) == ("", "", "")


def test_codon_offsets(spark):
    got = spark.range(1).select(*[proteins.codon_offset_after_trim(F.lit(7), F.lit(k)).alias(f"x{k}") for k in (2, 8, 10)]).first()
    assert tuple(got) == (5, 2, 0)


def test_subsequence(spark):
    row = [("ABCDEF", True, 2, 4, True, False)]
    frame = spark.createDataFrame(row, "amino_acids string, contains_mutation boolean, mutation_start_idx int, mutation_end_idx int, ends_with_stop_codon boolean, frameshift boolean")
    cut = lambda a, z: tuple(proteins.subsequence(frame, F.lit(a), F.lit(z).cast("int")).first())
    assert cut(1, 5) == ("BCDE", True, 1, 3, False, False)
    assert cut(4, None) == ("EF", False, 0, 0, True, False)
    assert cut(-3, None)[0] == "DEF"


def test_phasing(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (5, "c"), (5, "c"), (7, "x"), (8, "x"), (8, "y"), (7, "y")]
    names = spark.createDataFrame(rows, "variant_id long, name string")
    counts = phasing.shared_names(names)
    assert {(r.a, r.b): r.n for r in counts.collect()} == {(1, 2): 1, (2, 3): 1, (7, 8): 2}
    one = phasing.phased_pairs(counts, 1)
    assert {r.variant_id: r.partners for r in phasing.partners(one).collect()}[1] == [2]
    groups = {r.phase_group: r for r in phasing.phase_groups(one, names).collect()}
    assert groups[1].somatic_variants == [1, 2, 3] and groups[1].supporting_read_names == ["a", "b"] and groups[7].germline_variants == []
    assert [r.phase_group for r in phasing.phase_groups(phasing.phased_pairs(counts), names).collect()] == [7]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.phase_group for r in phasing.phase_components(chain).collect()} == {0}
    found = spark.createDataFrame([(1, 4), (9, 0)], "variant_id long, num_alt_fragments long")
    assert {r.variant_id: (r.has_evidence, r.partners_in_cis) for r in phasing.read_phasing(found, one).collect()} == {1: (True, [2]), 9: (False, [])}


def test_filters(spark):
    frame = spark.createDataFrame([(1, 5.0, True, None), (2, None, None, False)], "id int, x double, ok boolean, no boolean")
    got = {r.id: r for r in with_filters(frame, {"min_x": 3, "max_x": 9}, ["ok", "not_no"]).collect()}
    assert got[1]["passes_all_filters"] and got[1]["filter:not_no"] and not got[2]["filter:min_x"] and not got[2]["filter:ok"]
    for bad in ({"least_x": 1}, {"min_y": 1}):
        with pytest.raises(ValueError, match="x|y"):
            with_filters(frame, bad, [])
    with pytest.raises(ValueError, match="boolean"):
        with_filters(frame, {}, ["x"])
    with pytest.raises(ValueError, match="no column"):
        with_filters(frame, {}, ["not_there"])


def test_edits(inputs, transcripts):
    variants, alignments = inputs
    r = Run(variants, alignments, transcripts)
    known = edits.variant_edits(variants, transcripts)
    more = edits.unexplained_edits(r.proteins, known)
    rows = edits.mutant_transcripts(r.proteins, known, more, r.counts).collect()
    assert len(rows) == 3 and all(x.num_alt_reads >= 3 and x.edits for x in rows)
    (_, pos, ref, alt), new = snv("-", 160)
    minus = next(x for x in rows if x.transcript_id == "T-")
    assert [tuple(e)[:3] for e in minus.edits] == [(160, 161, new)]
    kinds = {x.category for x in edits.categorized_edits(known, more).collect()}
    assert "known_somatic" in kinds
    of_proteins = {x.variant_id: x for x in edits.protein_edits(r.proteins, known).collect()}
    assert len(of_proteins) == 3
    for x in rows:
        p = of_proteins[x.variant_id]
        assert {tuple(e)[1:4] for e in p.known_somatic} | {tuple(e)[1:4] for e in p.unexplained} == {tuple(e)[:3] for e in x.edits}
        assert p.known_germline == [] and p.known_somatic == sorted(p.known_somatic)


def test_tables_name_genes_and_count_source_reads(inputs, transcripts):
    variants, alignments = inputs
    stages = Run(variants, alignments, transcripts, Options())
    genes = {(r.chr, r.pos): r.gene for r in results.allele_reads_frame(stages.evidence, variants, transcripts).select("chr", "pos", "gene").distinct().collect()}
    (_, plus, *_), (_, minus, *_) = snv("+", 150)[0], snv("-", 160)[0]
    assert genes[("1", plus)] == "gene+" and genes[("2", minus)] == "gene-"
    assert {r.gene for r in results.gene_names(variants, transcripts).collect()} == {"gene+", "gene-"}
    assert {r.gene for r in results.gene_names(variants, None).collect()} == {""}
    far = readers.literal_variants(variants.sparkSession, [("1", 5, "A", "C")])
    assert [r.gene for r in results.gene_names(far, transcripts).collect()] == [""]
    frame = results.variant_sequences_frame(stages.sequences, variants, transcripts)
    assert frame.columns == ["chr", "pos", "ref", "alt", "prefix", "allele", "suffix", "sequence", "reads", "gene"]
    assert "source_read_count" not in results.allele_reads_frame(stages.evidence, variants).columns
    assert "source_read_count" not in results.locus_reads_frame(stages.locus_reads).columns

    # Each read stands for two, as merged mates do.
    doubled = Run(variants, alignments, transcripts, Options())
    doubled.evidence = stages.evidence.withColumn("source_read_count", F.lit(2).cast("long"))
    counts = [
        {r.untrimmed_variant_sequence: (r.untrimmed_variant_sequence_read_count, r.variant_orf, r.reference_context) for r in results.translations_frame(x.translations, variants).collect()}
        for x in (stages, doubled)
    ]
    assert counts[0].keys() == counts[1].keys() and len(counts[0]) >= 2
    for sequence, (n, orf, names) in counts[0].items():
        assert counts[1][sequence][0] == 2 * n > 0 and len(orf) % 3 == 0 and names in ("T+-1", "T--1")
    proteins_frame = results.protein_sequences_frame(stages.proteins, variants)
    assert {"reads", "gene"} <= set(proteins_frame.columns) and all(r.reads == r.num_supporting_reads > 0 for r in proteins_frame.collect())


def test_frames(spark):
    rows = spark.createDataFrame([(1, 3, [("a", 1), ("b", 2)]), (2, 4, [])], "variant_id long, n int, reads array<struct<name:string,k:int>>")
    variants = spark.createDataFrame([(1, "1", 5, "A", "C"), (2, "2", 6, "G", "")], readers.VARIANT_SCHEMA)
    got = results.frame(rows, variants, rename={"n": "m"}).orderBy("pos")
    assert [tuple(r) for r in got.collect()] == [("1", 5, "A", "C", 3, 2), ("2", 6, "G", "", 4, 0)] and got.columns[4:] == ["m", "reads"]
    whole = results.frame(rows, variants, sizes=False).where("pos = 5").first()
    assert [tuple(x) for x in whole.reads] == [("a", 1), ("b", 2)]
    each = results.exploded_frame(rows, variants, "reads", rename={"k": "number"}, extra={"one": F.lit(1)}).orderBy("name").collect()
    assert [tuple(r) for r in each] == [("1", 5, "A", "C", "a", 1, 1), ("1", 5, "A", "C", "b", 2, 1)]
    for wrong in ({"exclude": ("x",)}, {"converters": {"x": F.size}}, {"exclude": ("n",), "converters": {"n": F.abs}}):
        with pytest.raises(ValueError, match="no such columns"):
            results.frame(rows, variants, **wrong)


def test_names_from_proteins(spark):
    rows = [(1, 1, ["t2", "t1"], ["g1"]), (1, 2, ["t3", "t1"], ["g0"]), (2, 1, ["t9"], ["g9"])]
    made = [(v, k, t, [x + "n" for x in t], g, g) for v, k, t, g in rows]
    frame = spark.createDataFrame(made, "variant_id int, protein_rank int, " + ", ".join(f"{c} array<string>" for c in ("transcript_ids", "transcript_names", "gene_ids", "gene_names")))
    found = lambda most: {r.variant_id: (r.transcript_ids, r.gene_ids) for r in results.names_from_proteins(frame, most).collect()}
    assert found(None) == {1: (["t1", "t2", "t3"], ["g0", "g1"]), 2: (["t9"], ["g9"])}
    assert found(1)[1] == (["t1", "t2"], ["g1"])


def test_commands(spark, inputs, transcripts, tmp_path):
    variants, alignments = inputs
    alignments.write.parquet(str(tmp_path / "reads"))
    transcripts.write.parquet(str(tmp_path / "transcripts"))
    vcf = tmp_path / "v.vcf"
    vcf.write_text("".join(f"{r.contig}\t{r.pos}\t.\t{r.ref}\t{r.alt}\t.\t.\t.\n" for r in variants.collect()))
    rows = {"allele-counts": 4, "allele-reads": 34, "variant-sequences": 3, "reference-contexts": 3, "protein-sequences": 3, "results": 4}
    for command, n in rows.items():
        out = str(tmp_path / command)
        args = [command, "--vcf", str(vcf), "--bam", str(tmp_path / "reads"), "--transcripts", str(tmp_path / "transcripts"), "--output", out]
        cli.main(args, spark)
        got = spark.read.csv(out, header=True)
        assert got.count() == n, command
        if command != "results":
            assert got.columns[:4] == ["chr", "pos", "ref", "alt"]
    shorter = ["variant-sequences", *args[1:-1], str(tmp_path / "shorter"), "--variant-sequence-length", "63"]
    cli.main(shorter, spark)
    assert spark.read.csv(str(tmp_path / "shorter"), header=True).count() == 4
    strict = cli.options_of(cli.parser().parse_args([*args, "--min-alt-rna-reads", "7", "--min-alt-rna-fraction", "0.5", "--min-num-alt-fragments", "4"]))
    assert strict.thresholds == {"min_ratio_alt_to_other_fragments": 3.0, "min_fraction_alt_fragments": 0.5, "min_num_alt_fragments": 4, "min_num_alt_reads": 7}
    cli.main([*args[:-1], str(tmp_path / "few"), "--output-columns", "variant", "num_alt_reads"], spark)
    assert spark.read.csv(str(tmp_path / "few"), header=True).columns == ["variant", "num_alt_reads"]
