"""Alignments at loci through an index against a scan of the whole file."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spliceloom.operators.reads import locus_reads, locus_windows
from spliceloom.sources import readers
from spliceloom.sources.bam import bins_of, parse_index, parse_regions, read_bam, read_bam_at, region_chunks

CODES = "MIDNSHP=X"


def lowest_bin(start, end):
    """The smallest bin that holds all of an interval: the first level at which both ends agree, from the finest."""
    for first, bits in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if start >> bits == (end - 1) >> bits:
            return first + (start >> bits)
    return 0


def write_bam(path, contigs, records):
    """Records (name, contig number, pos from 0, cigar ops, sequence), sorted, in members of 500 bytes, and their index."""
    body = b"BAM\1" + struct.pack("<ii", 0, len(contigs))
    for name, size in contigs:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    spans = []
    for name, ref, pos, ops, seq in records:
        packed = bytes(("=ACMGRSVTWYHKDBN".index(seq[k]) << 4) | ("=ACMGRSVTWYHKDBN".index(seq[k + 1]) if k + 1 < len(seq) else 0) for k in range(0, len(seq), 2))
        data = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), 0, len(seq), -1, -1, 0) + name.encode() + b"\0"
        data += b"".join(struct.pack("<I", n << 4 | CODES.index(op)) for n, op in ops) + packed + bytes([30] * len(seq))
        begin = len(body)
        body += struct.pack("<i", len(data)) + data
        spans.append((ref, pos, pos + sum(n for n, op in ops if op in "MDN=X"), begin, len(body)))
    out, starts = b"", []
    for k in range(0, len(body), 500):
        starts.append(len(out))
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(body[k : k + 500]) + z.flush()
    path.write_bytes(out)
    place = lambda at: (starts[at // 500] << 16 | at % 500) if at < len(body) else len(out) << 16
    index = b"BAI\1" + struct.pack("<i", len(contigs))
    for ref in range(len(contigs)):
        bins, intervals, last = {}, {}, None
        for r, start, end, begin, stop in spans:
            if r != ref:
                continue
            b = lowest_bin(start, end)
            if last == b:
                bins[b][-1][1] = place(stop)
            else:
                bins.setdefault(b, []).append([place(begin), place(stop)])
            last = b
            for w in range(start >> 14, (end - 1 >> 14) + 1):
                intervals.setdefault(w, place(begin))
        index += struct.pack("<i", len(bins) + 1)
        for b, chunks in bins.items():
            index += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        index += struct.pack("<IiQQQQ", 37450, 2, 0, 0, 0, 0)
        n = max(intervals, default=-1) + 1
        index += struct.pack("<i", n) + struct.pack(f"<{n}Q", *[intervals.get(w, 0) for w in range(n)])
    return index


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(7)
    top = tmp_path_factory.mktemp("bam")
    for name, seed in (("a.bam", 1), ("b.bam", 2)):
        records = []
        for k in range(1200):
            ops = [(20, "M"), (rng.choice([300, 40_000, 900_000]), "N"), (20, "M")] if k % 10 == 0 else [(40, "M")]
            records.append((f"{name[0]}{k}", k // 1000, rng.randrange(3_000_000), ops, "".join(rng.choice("ACGT") for _ in range(40))))
        records.sort(key=lambda r: r[1:3])
        index = write_bam(top / name, [("chr1", 4_000_000), ("chr2", 4_000_000), ("chr3", 10)], records)
        (top / (name + ".bai" if seed == 1 else name[:-4] + ".bai")).write_bytes(index)
    return top


def key(r):
    return (r.read_ordinal, r.qname, r.rname, r.pos, r.cigar, r.seq)


def ends(r):
    return r.pos - 1 + sum(int(n) for n in __import__("re").findall(r"(\d+)[MDN=X]", r.cigar))


@pytest.mark.parametrize("remote", [False, True])
def test_chunks_of_loci_hold_all_their_reads(spark, folder, remote):
    path = ("file://" if remote else "") + str(folder)
    whole = [key(r) for r in read_bam(spark, path).collect()]
    assert len(whole) == len(set(whole)) == 2400 and len({k[0] for k in whole}) == 2400
    rng = random.Random(3)
    loci = [("chr1", p, p + n) for p, n in ((0, 1), (1_000_000, 50_000), (2_999_000, 5), (rng.randrange(3_000_000), 200), (16384, 1), (16383, 2))]
    loci += [("chr2", 500_000, 700_000), ("chr3", 0, 10), ("chr9", 5, 6), (None, 1, 2), ("chr1", -3, 9)]
    found = read_bam_at(spark, path, spark.createDataFrame(loci, "rname string, start long, end long")).collect()
    got = {key(r) for r in found}
    assert len(got) == len(found) < 1000
    over = {key(r) for r in read_bam(spark, path).collect() if any(r.rname == c and r.pos - 1 < e and ends(r) > max(s, 0) for c, s, e in loci)}
    assert over and over <= got <= set(whole)


def test_few_loci_start_few_tasks(spark, folder):
    path = str(folder / "a.bam")
    cut = read_bam(spark, path, split_bytes="500")
    assert cut.rdd.getNumPartitions() > 80
    loci = [("chr1", p, p + 1) for p in range(100_000, 2_600_000, 500_000)]
    at = read_bam_at(spark, path, spark.createDataFrame(loci, "rname string, start long, end long"))
    assert at.rdd.getNumPartitions() <= 10
    got = {key(r) for r in at.collect()}
    assert len(got) < 200 and got <= {key(r) for r in cut.collect()}


def test_locus_reads_are_the_same(spark, folder):
    path = str(folder / "a.bam")
    contigs = readers.read_contigs(spark, path)
    every = read_bam(spark, path).where("cigar = '40M'").orderBy("read_ordinal").limit(400).collect()
    variants = readers.literal_variants(spark, [(r.rname.removeprefix("chr"), r.pos + 7, r.seq[7], "A" if r.seq[7] != "A" else "C") for r in every[::80]])
    assert variants.count() == 5
    rows = []
    for alignments in (readers.read_alignments(spark, path), readers.read_alignments(spark, path, locus_windows(variants, contigs))):
        rows.append(sorted(tuple(map(str, r)) for r in locus_reads(variants, alignments, contigs=contigs).collect()))
    assert rows[0] == rows[1] and len(rows[0]) >= 5


def test_regions(spark, folder):
    path = str(folder)
    every = read_bam(spark, path).collect()
    for text, spans in (
        ("chr2", [("chr2", 1, 10**9)]),
        ("chr1:1,000,000-1,100,000", [("chr1", 1_000_000, 1_100_000)]),
        ("chr1:900000-1000000; chr1:950000-1200000;chr1:1300000-1300001;chr2:5-9", [("chr1", 900_000, 1_200_000), ("chr1", 1_300_000, 1_300_001), ("chr2", 5, 9)]),
        ("chr1:2500000-;no", [("chr1", 2_500_000, 10**9)]),
    ):
        want = sorted(key(r) for r in every if any(r.rname == c and r.pos <= z and ends(r) >= a for c, a, z in spans))
        assert sorted(key(r) for r in read_bam(spark, path, regions=text, split_bytes="2000").collect()) == want, text
    assert read_bam(spark, path, regions="no").count() == 0
    assert read_bam(spark, path, regions="chr1:100000-110000", split_bytes="500").rdd.getNumPartitions() < 12 < read_bam(spark, path, split_bytes="500").rdd.getNumPartitions()
    assert parse_regions("HLA:01:5-6;x:y") == [("HLA:01", 5, 6), ("x:y", 1, None)]


def test_filters_of_one_query_do_not_stay_for_the_next(spark, folder):
    rows = read_bam(spark, str(folder))
    assert [rows.count(), rows.where("rname = 'chr2'").count(), rows.count()] == [2400, 400, 2400]


def test_a_file_without_index_is_read_whole(spark, folder, tmp_path):
    (tmp_path / "c.bam").write_bytes((folder / "a.bam").read_bytes())
    loci = spark.createDataFrame([("chr1", 5, 6)], "rname string, start long, end long")
    assert read_bam_at(spark, str(tmp_path / "c.bam"), loci).count() == 1200
    with pytest.raises(Exception, match="no index"):
        read_bam(spark, str(tmp_path / "c.bam"), regions="chr1").count()
    with pytest.raises(FileNotFoundError):
        read_bam_at(spark, str(tmp_path / "none.bam"), loci)


def test_bins(spark):
    rng = random.Random(5)
    spans = [(0, 1), (16383, 16385), (0, 1 << 29), *((s, s + rng.choice([1, 50, 70_000])) for s in (rng.randrange(1 << 28) for _ in range(20)))]
    rows = spark.createDataFrame(spans, "s long, e long").select("s", "e", bins_of(F.col("s"), F.col("e")).alias("bins")).collect()
    for r in rows:
        assert lowest_bin(r.s, r.e) in r.bins and 0 in r.bins and len(set(r.bins)) == len(r.bins)


def test_region_chunks_skip_what_lies_before(folder):
    contig = parse_index((folder / "a.bam.bai").read_bytes())[0]
    late = region_chunks(contig, 2_900_000, 2_900_001)
    assert all(b < e for b, e in late) and min(b for b, _ in late) >= contig.intervals[2_900_000 >> 14] > 0
    with pytest.raises(ValueError, match="BAI"):
        parse_index(b"nothing")
