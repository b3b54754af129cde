"""Transcripts from GTF and FASTA files against a table made by hand."""

import random

import pytest
from test_pipeline import CDS, PROTEIN, SEQUENCE, UTR5, reverse, transcript

from spliceloom import cli
from spliceloom.sources import readers
from spliceloom.sources.annotation import read_annotation, read_fasta, read_gtf

RNG = random.Random(23)


def genome(strand):
    """A contig on which the hand-made transcript lies, with made-up bases around."""
    exons = transcript(strand)[8]
    bases = [RNG.choice("ACGT") for _ in range(3000)]
    at = 0
    for e in exons:
        n = e["end"] - e["start"] + 1
        piece = SEQUENCE[at : at + n]
        at += n
        bases[e["start"] - 1 : e["end"]] = piece if strand == "+" else reverse(piece)
    return "".join(bases)


def lines_of(strand, codons=True):
    """GTF lines of the transcript; coding parts end before the stop codon."""
    name, label, gene, gene_name, contig, _, biotype, _, exons, *_ = transcript(strand)
    rest = f'gene_id "{gene}"; transcript_id "{name}"; transcript_name "{label}"; gene_name "{gene_name}"; gene_biotype "{biotype}"; transcript_biotype "{biotype}";'
    contig = contig.removeprefix("chr")
    line = lambda feature, a, z, frame=".": f"{contig}\tmade\t{feature}\t{a}\t{z}\t.\t{strand}\t{frame}\t{rest}"
    out = [f'{contig}\tmade\tgene\t1\t9\t.\t{strand}\t.\tgene_id "{gene}";', line("transcript", 1, 9)]
    at, first, stop = 0, len(UTR5), len(UTR5) + len(CDS) - 3
    for e in exons:
        n = e["end"] - e["start"] + 1
        out.append(line("exon", e["start"], e["end"]))
        for feature, a, z in (("CDS", first, stop), ("start_codon", first, first + 3), ("stop_codon", stop, stop + 3)):
            low, high = max(a, at) - at, min(z, at + n) - at
            if low < high and (codons or feature == "CDS"):
                span = (e["start"] + low, e["start"] + high - 1) if strand == "+" else (e["end"] - high + 1, e["end"] - low)
                out.append(line(feature, *span, (3 - (max(a, at) - a) % 3) % 3))
        at += n
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("annotation")
    fasta = []
    for name, bases, width in (("chr1 first contig", genome("+"), 60), ("empty", "", 60), ("chr2\ttwo", genome("-"), 61), ("chrM", "acgtn" * 20, 7)):
        fasta += [f">{name}", *(bases[k : k + width] for k in range(0, len(bases), width))]
    (top / "genome.fa").write_text("\n".join(fasta).replace("ACG", "acg") + "\n")
    (top / "made.gtf").write_text("\n".join(["#!genome-build x", *lines_of("+"), *lines_of("-")]) + "\n")
    (top / "coding.gtf").write_text("\n".join([*lines_of("+", False), *lines_of("-", False)]) + "\n")
    return top


def plain(r):
    r = r.asDict(recursive=True)
    return r | {"contig": r["contig"].removeprefix("chr")}


@pytest.mark.parametrize("gtf", ["made.gtf", "coding.gtf"])
def test_equals_the_table_made_by_hand(spark, files, gtf):
    want = spark.createDataFrame([transcript("+"), transcript("-")], readers.TRANSCRIPT_SCHEMA)
    got = read_annotation(spark, str(files / gtf), str(files / "genome.fa"))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, map(plain, got.collect()))) == sorted(map(str, map(plain, want.collect())))
    assert got.first().protein == PROTEIN


@pytest.mark.parametrize("split", ["128", "500", "134217728"])
def test_chunks_cover_contigs(spark, files, split):
    """Also where splits end within contigs, lines and headers."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_fasta(spark, str(files / "genome.fa"), chunk=200).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    text = (files / "genome.fa").read_text()
    want = {p.split()[0]: "".join(p.split("\n")[1:]).upper() for p in text[1:].split("\n>")}
    assert {r.contig for r in rows} == {"chr1", "chr2", "chrM"}
    for contig in ("chr1", "chr2", "chrM"):
        mine = sorted((r.start, r.end, r.bases) for r in rows if r.contig == contig)
        assert [s for s, _, _ in mine] == [0, *(e for _, e, _ in mine[:-1])] and mine[-1][1] == len(want[contig])
        assert "".join(b for *_, b in mine) == want[contig]


def test_unknown_ends_and_contigs(spark, files, tmp_path):
    cut = [x.replace('gene_biotype', 'tag "cds_start_NF"; gene_biotype') for x in lines_of("+")]
    lost = [x.replace("2\tmade", "none\tmade") for x in lines_of("-")]
    (tmp_path / "x.gtf").write_text("\n".join([*cut, *lost, "bad line", "1\tx\texon\ta\tb\t.\t+\t.\tgene_id \"only\";"]) + "\n")
    rows = {r.transcript_id: r for r in read_annotation(spark, str(tmp_path / "x.gtf"), str(files / "genome.fa")).collect()}
    assert set(rows) == {"T+", "T-"}
    assert rows["T+"].start_codon_offset is None and not rows["T+"].complete and rows["T+"].protein is None and rows["T+"].sequence == SEQUENCE
    assert rows["T-"].sequence is None and rows["T-"].protein is None and not rows["T-"].complete and rows["T-"].start_codon_offset == len(UTR5)
    (tmp_path / "none.gtf").write_text("#nothing\n")
    assert read_gtf(spark, str(tmp_path / "none.gtf")).count() == 0
    assert read_annotation(spark, str(tmp_path / "none.gtf"), str(files / "genome.fa")).count() == 0


def test_command_reads_annotation_named_by_the_variants(spark, files, tmp_path):
    """The VCF header's reference picks the annotation; the table of contexts needs no reads."""
    bases = genome("+")
    (tmp_path / "v.vcf").write_text(f"##reference=made\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t1200\t.\t{transcript('+')[9][149]}\tN\t.\t.\t.\n")
    args = ["reference-contexts", "--vcf", str(tmp_path / "v.vcf"), "--gtf", str(files) + "/{reference}.gtf", "--fasta", str(files / "genome.fa"), "--output", str(tmp_path / "out")]
    cli.main(args, spark)
    rows = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert len(rows) == 1 and rows[0].gene == "gene+" and rows[0].pos == "1200"
    assert len(bases) == 3000
    with pytest.raises(SystemExit, match="reference"):
        cli.main(["reference-contexts", "--variant", "1", "5", "A", "C", "--gtf", "{reference}.gtf", "--fasta", "x.fa", "--output", str(tmp_path / "no")], spark)
