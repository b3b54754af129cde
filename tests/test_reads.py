"""Reads at loci on hand-made alignments."""

import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spliceloom.functions.cigar import aligned_blocks
from spliceloom.functions.indels import left_aligned_interval as left_aligned
from spliceloom.operators.evidence import allele_counts, counts_for_variants, with_fractions
from spliceloom.operators.mates import Read, merge_group, merge_mates, merge_pair
from spliceloom.operators.reads import ReadOptions, allele_reads, locus_reads, modal_allele, read_evidence, reads_at_locus
from spliceloom.sources import readers
from spliceloom.sources.bam import read_bam

SCHEMA = "read_ordinal long, qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, md string"


def alignments(spark, rows):
    full = [(k, f"r{k}", r.get("flag", 0), r.get("rname", "1"), r["start"] + 1, r.get("mapq", 10), r["cigar"], r["seq"], r.get("qual", "?" * len(r["seq"])), r.get("md")) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def alleles(spark, variant, rows, **options):
    variants = readers.literal_variants(spark, [variant])
    found = allele_reads(locus_reads(variants, alignments(spark, rows), ReadOptions(**options)))
    got = read_evidence(variants, found).orderBy("read_ordinal").collect()
    return [(r.prefix, r.allele, r.suffix, r.allele_class) for r in got]


def read(seq, cigar, start, md=None, **more):
    return {"seq": seq, "cigar": cigar, "start": start, "md": md, **more}


def test_substitution(spark):
    assert alleles(spark, ("1", 4, "T", "G"), [read("ACCGTG", "6M", 0, "3G2")]) == [("ACC", "G", "TG", "alt")]


def test_insertion_and_deletion(spark):
    assert alleles(spark, ("1", 10, "T", "TG"), [read("ACCTGTG", "4M1I2M", 6)]) == [("ACCT", "G", "TG", "alt")]
    assert alleles(spark, ("1", 4, "TT", "T"), [read("ACCTG", "4M1D1M", 0, "4^T1")]) == [("ACCT", "", "G", "alt")]


def test_edges(spark):
    rows = [read("GAAA", "4M", 3), read("AAAG", "4M", 0), read("TAAA", "4M", 3), read("AAAT", "4M", 0)]
    assert [x[3] for x in alleles(spark, ("1", 4, "T", "G"), rows)] == ["alt", "alt", "ref", "ref"]
    rows = [read("GT", "1I1M", 3), read("AG", "1M1I", 2), read("T", "1M", 3), read("A", "1M", 2)]
    assert [x[3] for x in alleles(spark, ("1", 3, "A", "AG"), rows)] == ["alt", "alt", "ref", "ref"]


def test_spliced_reads(spark):
    assert alleles(spark, ("1", 4, "T", "G"), [read("ACCGTGGA", "4M100N4M", 0)])[0][1] == "G"
    assert alleles(spark, ("1", 105, "T", "G"), [read("ACCTGGGA", "4M100N4M", 0)])[0][1] == "G"
    assert alleles(spark, ("1", 50, "T", "G"), [read("ACCTGGGA", "4M100N4M", 0)]) == []


def test_left_alignment(spark):
    assert alleles(spark, ("1", 1, "A", "AA"), [read("AAAA", "2M1I1M", 0, "3")]) == [("A", "A", "AA", "alt")]
    assert alleles(spark, ("1", 1, "AA", "A"), [read("AAA", "2M1D1M", 0, "2^A1")]) == [("A", "", "AA", "alt")]


def left_aligned_interval(seq: str, cigar: str, md: str, start: int, pos: int, ref: str, alt: str) -> tuple[int, int] | None:
    """Where an indel of the read lies on it, if the indel or one of its left shifts is the trimmed variant.

    ``start`` is the read's first reference position from 0; the reference bases come from the MD tag.
    """
    pairs: list[tuple[int | None, int | None]] = []
    i, r = 0, start
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                pairs.append((i, r))
            elif op == "I":
                pairs.append((i, None))
            elif op == "D":
                pairs.append((None, r))
            i += op in "M=XIS"
            r += op in "M=XDN"
    deleted = {p: None for a, p in pairs if a is None}
    aligned = [(a, p) for a, p in pairs if a is not None and p is not None]
    bases: dict[int, str] = {}
    at, removed = 0, list(deleted)
    for n, gap, base in re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md.upper()):
        if n:
            for a, p in aligned[at : at + int(n)]:
                bases[p] = seq[a]
            at += int(n)
        elif gap:
            for p, c in zip(removed, gap):
                bases[p] = c
            removed = removed[len(gap) :]
        elif at < len(aligned):
            bases[aligned[at][1]] = base
            at += 1
    k = 0
    while k < len(pairs):
        a, p = pairs[k]
        if a is not None and p is not None:
            k += 1
            continue
        end = k
        while end < len(pairs) and (pairs[end][0] is None, pairs[end][1] is None) == (a is None, p is None):
            end += 1
        run, before = pairs[k:end], k - 1
        if p is None:
            text = "".join(seq[x] for x, _ in run)
            lo, hi = run[0][0], run[-1][0] + 1
        else:
            text = "".join(bases.get(x, "N") for _, x in run)
            lo = hi = pairs[before][0] + 1 if before >= 0 and pairs[before][0] is not None else 0
        while before >= 0 and pairs[before][0] is not None and pairs[before][1] is not None:
            last = pairs[before][1]
            if p is None and (last + 1, "", text) == (pos, ref, alt) or p is not None and (last + 2, text, "") == (pos, ref, alt):
                return lo, hi
            base = bases.get(last)
            if base is None or base != text[-1]:
                break
            text, lo, hi, before = base + text[:-1], lo - 1, hi - 1, before - 1
        k = end
    return None


def test_left_alignment_in_closed_form(spark):
    """Reads with all kinds of operations against shifting base by base; variants are places that shifts reach, and others."""
    rng = random.Random(21)
    rows = []
    for _ in range(400):
        ops, seq, md, run, ref = [], "", "", 0, 10
        if rng.random() < 0.3:
            ops.append((2, "S"))
            seq += "".join(rng.choice("AC") for _ in range(2))
        hits = []
        for k in range(rng.randint(2, 5)):
            n = rng.randint(1, 8)
            ops.append((n, "M"))
            for _ in range(n):
                base = rng.choice("AC")
                seq += base
                if rng.random() < 0.05:
                    md, run = md + str(run) + "G", 0
                else:
                    run += 1
            ref += n
            op = rng.choice("IIDDN-")
            n = rng.randint(1, 4)
            if op == "I":
                text = "".join(rng.choice("AC") for _ in range(n))
                ops.append((n, "I"))
                seq += text
                hits.append((ref, "", text))
                if rng.random() < 0.1:
                    ops += [(1, "P"), (1, "I")]
                    seq += "A"
            elif op == "D":
                text = "".join(rng.choice("AC") for _ in range(n))
                ops.append((n, "D"))
                md, run = md + str(run) + "^" + text, 0
                hits.append((ref + 1, text, ""))
                ref += n
            elif op == "N":
                ops.append((10, "N"))
                ref += 10
        ops.append((3, "M"))
        seq += "CAC"
        md += str(run + 3) if rng.random() < 0.9 else ""
        cigar = "".join(f"{n}{op}" for n, op in ops)
        for pos, r, a in hits[:2]:
            for back in range(4):
                text = r or a
                turned = text[-back % len(text) :] + text[: -back % len(text)] if back else text
                rows.append((seq, cigar, md, 10, pos - back, turned if r else "", turned if a else ""))
    frame = spark.createDataFrame(rows, "seq string, cigar string, md string, start long, p long, r string, a string").withColumn("pos", F.col("start") + 1)
    frame = frame.withColumn("blocks", aligned_blocks("cigar", "pos"))
    found = frame.select("*", left_aligned(*map(F.col, ("seq", "cigar", "md", "blocks", "p", "r", "a"))).alias("got")).collect()
    shifted = 0
    for x in found:
        want = left_aligned_interval(x.seq, x.cigar, x.md, x.start, x.p, x.r, x.a)
        assert (x.got and tuple(x.got)) == want, x
        shifted += want is not None
    assert 300 < shifted < len(found) - 300


def test_reads_of_a_bare_locus(spark):
    rows = alignments(spark, [read("ACCGTG", "6M", 0), read("CGTGAA", "2M2I2M", 2), read("AC", "2M", 50), read("ACCG", "2M3D2M", 1)])
    columns = ("read_ordinal", "sequence", "reference_base0_start", "reference_base0_end", "read_base0_start", "read_base0_end")
    for start, end, variant in ((3, 4, ("1", 4, "A", "C")), (3, 5, ("1", 4, "AA", "CC")), (4, 4, ("1", 4, "A", "AGGGGG"))):
        want = locus_reads(readers.literal_variants(spark, [variant]), rows).select(*columns)
        got = reads_at_locus(rows, "chr1", start, end)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect())) != []
        assert {r.variant_id for r in got.collect()} == {f"chr1:{start}-{end}"}
    assert reads_at_locus(rows, "1", 500, 501).count() == 0
    with pytest.raises(ValueError, match="interval"):
        reads_at_locus(rows, "1", 5, 4)


def test_filters_and_contigs(spark):
    r = [read("ACCGTG", "6M", 0, flag=f, mapq=q, rname=c) for f, q, c in [(0, 10, "chr1"), (4, 10, "chr1"), (256, 10, "chr1"), (1024, 10, "chr1"), (0, 0, "chr1"), (2048, 255, "chr1")]]
    assert len(alleles(spark, ("1", 4, "T", "G"), r)) == 3
    assert len(alleles(spark, ("1", 4, "T", "G"), r, use_secondary=False, use_duplicates=True, min_mapping_quality=0)) == 4


def test_soft_clips(spark):
    rows = [read("TTACCGTGC", "2S6M1S", 0)]
    assert alleles(spark, ("1", 4, "T", "G"), rows) == [("ACC", "G", "TG", "alt")]
    assert alleles(spark, ("1", 4, "T", "G"), rows, use_soft_clipped=True) == [("TTACC", "G", "TGC", "alt")]


def test_n_ends_the_context(spark):
    assert alleles(spark, ("1", 4, "T", "G"), [read("NCCGTN", "6M", 0)]) == [("CC", "G", "T", "alt")]
    assert alleles(spark, ("1", 4, "T", "G"), [read("ACCNTG", "6M", 0)]) == []


def test_mates_merge(spark):
    a = Read("ACCGTG", tuple(range(6)), (30,) * 6, 3, 4, 1)
    b = Read("CGTGAA", tuple(range(2, 8)), (30,) * 6, 1, 2, 1)
    both = merge_pair(a, b)
    assert (both.sequence, both.start, both.end, both.count) == ("ACCGTGAA", 3, 4, 2)
    assert merge_pair(a, Read("CTTGAA", tuple(range(2, 8)), (30,) * 6, 1, 2, 1)) is None
    assert merge_pair(a, Read("CTTGAA", tuple(range(2, 8)), (20,) * 6, 1, 2, 1)).sequence == "ACCGTGAA"
    # Empty intervals: inside a read at their base, at a read's end at the end of the merged read.
    left, right = Read("ACCGTG", tuple(range(6)), (30,) * 6, 6, 6, 1), Read("CGTGAA", tuple(range(2, 8)), (30,) * 6, 0, 0, 1)
    assert (merge_pair(left, right).start, merge_pair(right, left).start) == (8, 0)
    inside = Read("ACCGTG", tuple(range(6)), (30,) * 6, 3, 3, 1)
    assert (merge_pair(inside, right).start, merge_pair(inside, right).end) == (3, 3)
    lost = Read("ACG", (None,) * 3, (30,) * 3, 0, 1, 1)
    assert [r.sequence for r in merge_group([lost, b, a])] == ["ACCGTGAA", "ACG"]
    assert len(merge_group([a, b, Read("AA", (20, 21), (30, 30), 0, 1, 1)])) == 2
    rows = alignments(spark, [read("ACCGTG", "6M", 0), read("CGTGAA", "6M", 2)]).replace({"r1": "r0"}, subset=["qname"])
    merged = locus_reads(readers.literal_variants(spark, [("1", 4, "T", "G")]), rows, ReadOptions(merge_overlapping_mates=True)).collect()
    assert [(r.sequence, r.source_read_count) for r in merged] == [("ACCGTGAA", 2)]


def test_pairs_merge_by_aggregation_as_one_by_one(spark):
    """Random pairs: overlapping or not, with insertions, clips, gaps, conflicts and empty intervals."""
    rng = random.Random(9)
    schema = (
        "variant_id long, read_ordinal long, name string, sequence string, reference_positions array<long>, quality_scores array<int>, source_read_count long, "
        "reference_base0_start long, reference_base0_end long, read_base0_start long, read_base0_end long"
    )
    truth = "".join(rng.choice("ACGT") for _ in range(60))
    rows = []
    for k in range(300):
        for half in range(2):
            positions, p = [], rng.randint(0, 12) + 6 * half
            for _ in range(rng.randint(3, 12)):
                positions.append(None if rng.random() < 0.12 else p)
                p += (positions[-1] is not None) * (1 if rng.random() < 0.93 else 3)
            if k % 37 == 0 and half:
                positions = [None] * len(positions)
            bases = "".join("A" if p is None else truth[p] if rng.random() < 0.97 else "T" for p in positions)
            start = rng.randint(0, len(bases))
            end = min(len(bases), start + rng.choice([0, 1, 2]))
            rows.append((k % 5, 1000 - 2 * k + half, f"n{k}", bases, positions, [rng.choice([20, 30, 30]) for _ in bases], 1, 5, 6, start, end))
    frame = spark.createDataFrame(rows, schema)
    got = {(r.name, r.read_ordinal): tuple(r)[3:7] + tuple(r)[9:] for r in merge_mates(frame).collect()}
    want = {}
    for k in range(300):
        mine = sorted((r for r in rows if r[2] == f"n{k}"), key=lambda r: r[1])
        for n, m in enumerate(merge_group([Read(r[3], tuple(r[4]), tuple(r[5]), r[9], r[10], r[6]) for r in mine])):
            want[f"n{k}", mine[n][1]] = (m.sequence, list(m.positions), list(m.qualities), m.count, m.start, m.end)
    assert 320 < len(want) < 580
    assert got == want


def test_counts(spark):
    rows = [(1, "ref", "a", 1), (1, "ref", "a", 1), (1, "alt", "b", 2), (1, "other", "c", 1), (1, "other", "d", 2), (1, "alt", "c", 0)]
    frame = spark.createDataFrame(rows, "variant_id long, allele_class string, name string, source_read_count long")
    r = with_fractions(allele_counts(frame)).first()
    assert (r.num_ref_reads, r.num_alt_reads, r.num_other_reads) == (2, 2, 3)
    assert (r.num_ref_fragments, r.num_alt_fragments, r.num_other_fragments, r.num_total_fragments) == (1, 2, 2, 4)
    assert r.fraction_alt_reads == pytest.approx(2 / 7) and r.ratio_alt_to_other_fragments == 1.0
    variants = readers.literal_variants(spark, [("1", 4, "T", "G")])
    assert counts_for_variants(variants, frame).first().num_total_reads == 0


def test_modal_allele(spark):
    rows = [(1, 3, "A"), (1, 2, "C"), (1, 4, "C"), (1, 5, "A"), (2, 1, "T")]
    frame = spark.createDataFrame(rows, "variant_id long, read_ordinal long, allele string")
    assert {(r.variant_id, r.allele) for r in modal_allele(frame).collect()} == {(1, "C"), (2, "T")}


def bam_bytes(records):
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 1000)
    for name, flag, pos, ops, seq, quals, tags in records:
        packed = bytes(("=ACMGRSVTWYHKDBN".index(seq[k]) << 4) | ("=ACMGRSVTWYHKDBN".index(seq[k + 1]) if k + 1 < len(seq) else 0) for k in range(0, len(seq), 2))
        data = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        data += b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + packed + bytes(quals) + tags
        body += struct.pack("<i", len(data)) + data
    out = b""
    for k in range(0, len(body), 70):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(body[k : k + 70]) + z.flush()
    return out


def test_bam(spark, tmp_path):
    records = [("q1", 0, 0, [(4, 0), (1, 1), (2, 0)], "ACCTGTG", [30] * 7, b"NMC\1MDZ6\0"), ("q2", 16, 5, [(3, 0)], "ACG", [255] * 3, b"")]
    path = tmp_path / "x.bam"
    path.write_bytes(bam_bytes(records))
    got = readers.read_alignments(spark, str(path)).orderBy("read_ordinal").collect()
    assert [(r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual, r.md) for r in got] == [
        ("q1", 0, "1", 1, "4M1I2M", "ACCTGTG", "?" * 7, "6"),
        ("q2", 16, "1", 6, "3M", "ACG", "*", None),
    ]
    with pytest.raises(ValueError, match="CRAM"):
        readers.read_alignments(spark, "x.cram")
    assert [r.rname for r in readers.read_contigs(spark, str(path)).collect()] == ["1"]


def test_bam_is_cut_at_records_of_its_index(spark, tmp_path):
    records = [(f"q{k}", 0, k, [(5, 0)], "ACGTA", [30] * 5, b"") for k in range(30)]
    data = bam_bytes(records)
    (tmp_path / "x.bam").write_bytes(data)
    members, body, at = [], b"", 0  # (offset in the file, offset in the text)
    while at < len(data):
        z = zlib.decompressobj(31)
        members.append((at, len(body)))
        body += z.decompress(data[at:])
        at = len(data) - len(z.unused_data)
    places, k = [], body.index(struct.pack("<i", 1000)) + 4
    while k < len(body):
        start, inside = next((a, k - b) for a, b in reversed(members) if b <= k)
        places.append(start << 16 | inside)
        k += 4 + struct.unpack_from("<i", body, k)[0]
    assert len(places) == 30
    chunks = b"".join(struct.pack("<QQ", p, p) for p in places[::2])
    index = b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 2) + struct.pack("<Ii", 0, 15) + chunks + struct.pack("<IiQQ", 37450, 1, 7, 7)
    (tmp_path / "x.bam.bai").write_bytes(index + struct.pack("<iQQ", 2, 0, places[1]))
    whole = read_bam(spark, str(tmp_path / "x.bam"))
    cut = read_bam(spark, str(tmp_path / "x.bam"), split_bytes="200")
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() > 4
    names = [[r.qname for r in frame.orderBy("read_ordinal").collect()] for frame in (whole, cut)]
    assert names[0] == names[1] == [f"q{k}" for k in range(30)]


def test_text_sources(spark, tmp_path):
    vcf = tmp_path / "v.vcf"
    vcf.write_text("##reference=x\n#CHROM POS ID REF ALT QUAL FILTER INFO\nchr1\t5\t.\tc\tCG,T\t.\t.\t.\n")
    assert {(r.contig, r.pos, r.ref, r.alt) for r in readers.read_vcf(spark, str(vcf)).collect()} == {("chr1", 5, "C", "CG"), ("chr1", 5, "C", "T")}
    assert readers.vcf_reference(spark, str(vcf)) == "x"
    maf = tmp_path / "v.maf"
    maf.write_text("#v\nChromosome\tStart_Position\tReference_Allele\tTumor_Seq_Allele1\tTumor_Seq_Allele2\n1\t7\tA\tA\t-\n")
    assert [(r.pos, r.ref, r.alt) for r in readers.read_maf(spark, str(maf)).collect()] == [(7, "A", "")]
    sam = tmp_path / "v.sam"
    sam.write_text("@HD\tVN:1\n@SQ\tSN:chr1\tLN:9\nq\t0\tchr1\t3\t60\t3M\t*\t0\t0\tacg\tIII\tNM:i:0\tMD:Z:3\n")
    r = readers.read_sam(spark, str(sam)).first()
    assert (r.qname, r.pos, r.seq, r.md) == ("q", 3, "ACG", "3")
    assert [r.rname for r in readers.read_contigs(spark, str(sam)).collect()] == ["chr1"]
    with pytest.raises(ValueError, match="no such columns"):
        readers.write_table(spark.range(1), str(tmp_path / "o"), ["nope"])
