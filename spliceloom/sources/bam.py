"""BAM files as a Spark data source, and alignments at given loci through their indexes.

A file with an index (FILE.bai or FILE with .bai for .bam) is cut into ranges of about ``split_bytes`` compressed bytes
that begin at records, one task each; a file without index is one task. Paths with a scheme are opened through Arrow's
file systems, others as files that all executors see.

With the option ``regions`` only chunks whose bins meet a region are read. Loci that are rows themselves go to
``read_bam_at``, which joins them with the bins of the indexes.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..plans.scratch import stage_table

SCHEMA = "read_ordinal long, qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, md string"
FIELDS = [tuple(f.split()) for f in SCHEMA.split(", ")]
ARROW_SCHEMA = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for name, kind in FIELDS])
BATCH = 4096
# Fixed values of the format: codes of bases and operations, and bytes of each tag type.
SEQ_CODES = "=ACMGRSVTWYHKDBN"
CIGAR_CODES = "MIDNSHP=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
# Fixed values of the index: the first bin of each level and the bits of a position in its bins, the bin of counts, bits of an interval.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
COUNTS_BIN = 37450
INTERVAL_BITS = 14

HEX_TO_BASE = str.maketrans("0123456789abcdef", SEQ_CODES)
TO_PRINTED = bytes(min(q + 33, 255) for q in range(256))


def _open(path: str):
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def bam_files(path: str) -> list[tuple[str, int]]:
    """Files (path, bytes) of a path in order: one file, a pattern of local files, or the .bam files of a folder."""
    if "://" not in path:
        names = sorted(glob.glob(os.path.join(path, "*.bam"))) if os.path.isdir(path) else sorted(glob.glob(path))
        found = [(p, os.path.getsize(p)) for p in names]
    else:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.Directory:
            scheme = path[: path.rindex(name)] if name and path.endswith(name) else path[: path.index("://") + 3]
            found = sorted((scheme + f.path, f.size) for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(".bam"))
        else:
            found = [(path, info.size)] if info.type == fs.FileType.File else []
    if not found:
        raise FileNotFoundError(path)
    return found


def read_index(path: str) -> bytes | None:
    """The index of a BAM file, local or remote; null if it has none."""
    for name in dict.fromkeys((path + ".bai", path.removesuffix(".bam") + ".bai")):
        try:
            with _open(name) as f:
                return f.read()
        except FileNotFoundError:
            continue
    return None


class _Stream:
    """Bytes of concatenated gzip members, with places as indexes name them: a member's offset << 16 | a byte in it."""

    def __init__(self, path: str) -> None:
        self.file = _open(path)
        self.seek(0)

    def seek(self, place: int) -> None:
        self.file.seek(place >> 16)
        self.at = self.next = place >> 16
        self.raw, self.held, self.used = b"", b"", 0
        if place & 0xFFFF:
            self._member()
            self.used = place & 0xFFFF

    def tell(self) -> int:
        return self.next << 16 if self.used == len(self.held) else self.at << 16 | self.used

    def _member(self) -> bool:
        """Take the next member; false at the end of the file."""
        inflate, out, fed = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            data = self.raw or self.file.read(1 << 16)
            self.raw = b""
            if not data:
                break
            fed += len(data)
            out.append(inflate.decompress(data))
        self.raw = inflate.unused_data
        self.at, self.next = self.next, self.next + fed - len(self.raw)
        self.held, self.used = b"".join(out), 0
        return fed > 0

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.used == len(self.held) and not self._member():
                break
            out.append(self.held[self.used : self.used + n])
            self.used += len(out[-1])
            n -= len(out[-1])
        return b"".join(out)


@dataclass
class ContigIndex:
    """Chunks (begin, end) of each bin of a contig, and the first place of each interval (0 if none)."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    intervals: tuple[int, ...] = ()


def parse_index(index: bytes) -> list[ContigIndex]:
    """The contigs of a BAI index, in the order of the file's header."""
    if index[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    (n_contigs,) = struct.unpack_from("<i", index, 4)
    at, found = 8, []
    for _ in range(n_contigs):
        contig = ContigIndex()
        (n_bins,) = struct.unpack_from("<i", index, at)
        at += 4
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", index, at)
            places = struct.unpack_from(f"<{2 * n_chunks}Q", index, at + 8)
            at += 8 + 16 * n_chunks
            if number != COUNTS_BIN:  # the bin of counts holds no places
                contig.bins[number] = list(zip(places[::2], places[1::2]))
        (n_intervals,) = struct.unpack_from("<i", index, at)
        contig.intervals = struct.unpack_from(f"<{n_intervals}Q", index, at + 4)
        at += 4 + 8 * n_intervals
        found.append(contig)
    return found


def record_places(contigs: Iterable[ContigIndex]) -> list[int]:
    """Places in the file at which records begin, in order."""
    return sorted({p for c in contigs for p in (*(begin for chunks in c.bins.values() for begin, _ in chunks), *c.intervals)} - {0})


def region_chunks(contig: ContigIndex, start: int, end: int | None) -> list[tuple[int, int]]:
    """Disjoint ranges of places, in order, that hold all records over positions from ``start`` to before ``end`` (from 0)."""
    top = (1 << 29) if end is None else max(end, start + 1)
    window = start >> INTERVAL_BITS
    least = contig.intervals[window] if window < len(contig.intervals) else 0
    wanted = [c for first, bits in LEVELS for b in range(first + (start >> bits), first + (top - 1 >> bits) + 1) if b in contig.bins for c in contig.bins[b] if c[1] > least]
    out: list[tuple[int, int]] = []
    for begin, stop in sorted((max(b, least), e) for b, e in wanted):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((begin, stop))
    return out


def _ranges(index: bytes | None, split_bytes: int) -> list[tuple[int | None, int | None]]:
    """Ranges (begin, end) of places that make up the file; null for the file's begin and end."""
    cuts: list[int] = []
    last = 0
    for place in record_places(parse_index(index)) if index else []:
        if (place >> 16) - last >= split_bytes:
            cuts.append(place)
            last = place >> 16
    return list(zip([None, *cuts], [*cuts, None]))


def _md_tag(data: bytes) -> str | None:
    at = 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if tag == b"MD":
                return data[at:end].decode()
            at = end + 1
        elif kind == "B":
            (n,) = struct.unpack_from("<i", data, at + 1)
            at += 5 + n * TAG_BYTES[chr(data[at])]
        else:
            at += TAG_BYTES[kind]
    return None


def _contigs(stream: _Stream, path: str) -> list[str]:
    if stream.read(4) != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    (n,) = struct.unpack("<i", stream.read(4))
    stream.read(n)
    names = []
    (n,) = struct.unpack("<i", stream.read(4))
    for _ in range(n):
        (size,) = struct.unpack("<i", stream.read(4))
        names.append(stream.read(size)[:-1].decode())
        stream.read(4)
    return names


@dataclass(frozen=True)
class Piece:
    """A range of places of a file; ``base`` is the number of bytes in the files before it.

    ``after`` and ``before`` (contig number, position from 0) leave out records that end up to ``after``, and all from
    ``before`` on; ``since`` leaves out those that begin before it.
    """

    path: str
    base: int
    begin: int | None = None
    end: int | None = None
    after: tuple[int, int] | None = None
    before: tuple[int, int] | None = None
    since: tuple[int, int] | None = None


def decode_bam(piece: Piece, headers: dict[str, list[str]]) -> Iterator[tuple]:
    """Records that begin in a piece, as rows of ``SCHEMA``; ``headers`` keeps the contigs of files that were read before.

    A record's read_ordinal is its place in the files laid end to end, so it is the same however they are read.
    """
    stream = _Stream(piece.path)
    if piece.begin is None or piece.path not in headers:
        headers[piece.path] = _contigs(stream, piece.path)
    names = headers[piece.path]
    if piece.begin is not None:
        stream.seek(piece.begin)
    base = piece.base << 16
    while (piece.end is None or stream.tell() < piece.end) and (place := stream.tell()) is not None and len(head := stream.read(4)) == 4:
        data = stream.read(struct.unpack("<i", head)[0])
        ref, pos, name_size, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", data)
        if piece.before and (ref, pos) >= piece.before:
            break
        if piece.since and (ref, pos) < piece.since:
            continue
        at = 32 + name_size
        ops = struct.unpack_from(f"<{n_ops}I", data, at)
        if piece.after and (ref, pos + (sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8)) or 1)) <= piece.after:
            continue
        name = data[32 : at - 1].decode()
        at += 4 * n_ops
        seq = data[at : at + (n_seq + 1) // 2].hex().translate(HEX_TO_BASE)[:n_seq]
        at += (n_seq + 1) // 2
        quals = data[at : at + n_seq]
        at += n_seq
        cigar = "".join(f"{x >> 4}{CIGAR_CODES[x & 15]}" for x in ops) or "*"
        qual = "*" if not n_seq or quals[0] == 255 else quals.translate(TO_PRINTED).decode("latin-1")
        yield base + place, None if name == "*" else name, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, seq or "*", qual, _md_tag(data[at:])


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW_SCHEMA)], schema=ARROW_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW_SCHEMA)], schema=ARROW_SCHEMA)


class _Task(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces


def parse_regions(text: str) -> list[tuple[str, int, int | None]]:
    """Regions (contig, first, last position from 1; null for the contig's end) of a text such as ``chr1:5-90;chr2``."""
    found = []
    for part in filter(None, (x.strip() for x in text.split(";"))):
        name, _, span = part.rpartition(":")
        first, _, last = span.replace(",", "").partition("-")
        if name and first.isdigit() and (not last or last.isdigit()):
            found.append((name, int(first), int(last) if last else None))
        else:
            found.append((part, 1, None))
    return found


class _Reader(DataSourceReader):
    # Filters are not pushed down: this version of Spark keeps them for later queries on the same table.
    def __init__(self, path: str, split_bytes: int, contigs: bool, regions: list[tuple[str, int, int | None]] | None) -> None:
        self.path, self.split_bytes, self.contigs, self.regions = path, split_bytes, contigs, regions

    def partitions(self) -> list[InputPartition]:
        tasks, base = [], 0
        for path, size in bam_files(self.path):
            if self.contigs:
                tasks.append(_Task([Piece(path, base)]))
            elif self.regions is None:
                tasks += [_Task([Piece(path, base, begin, end)]) for begin, end in _ranges(read_index(path), self.split_bytes)]
            else:
                tasks += self._region_tasks(path, base)
            base += size
        return tasks or [_Task([])]

    def _region_tasks(self, path: str, base: int) -> Iterator[_Task]:
        """Tasks of the chunks that meet a region, about ``split_bytes`` each."""
        if (index := read_index(path)) is None:
            raise ValueError(f"{path} has no index, so it can't be read by region")
        held: list[Piece] = []
        size = 0
        for k, (name, contig) in enumerate(zip(_contigs(_Stream(path), path), parse_index(index))):
            spans: list[list] = []  # disjoint, so that no record comes twice
            for first, last in sorted((f, l) for n, f, l in self.regions if n == name):
                if spans and (spans[-1][1] is None or first <= spans[-1][1] + 1):
                    spans[-1][1] = None if last is None or spans[-1][1] is None else max(last, spans[-1][1])
                else:
                    spans.append([first, last])
            reached = 0  # a record belongs to the first region it reaches
            for first, last in spans:
                before = (k + 1, -1) if last is None else (k, last)
                for begin, end in region_chunks(contig, first - 1, last):
                    held.append(Piece(path, base, begin, end, (k, first - 1), before, (k, reached)))
                    size += (end >> 16) - (begin >> 16)
                    if size >= self.split_bytes:
                        yield _Task(held)
                        held, size = [], 0
                reached = last
        if held:
            yield _Task(held)

    def read(self, partition: _Task) -> Iterator:
        if self.contigs:
            return ((name,) for p in partition.pieces for name in _contigs(_Stream(p.path), p.path))
        headers: dict[str, list[str]] = {}
        return batches(row for p in partition.pieces for row in decode_bam(p, headers))


class BamSource(DataSource):
    """spark.read.format("spliceloom_bam").load(path): a file, a pattern or a folder.

    Option split_bytes is the size of a task's range. Option regions ("chr1:5-90;chr2", positions from 1, ends included)
    reads only records over them, by the index. contigs=true reads only the names in the headers.
    """

    @classmethod
    def name(cls) -> str:
        return "spliceloom_bam"

    def schema(self) -> str:
        return "rname string" if self.options.get("contigs") == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        regions = parse_regions(self.options["regions"]) if "regions" in self.options else None
        return _Reader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)), self.options.get("contigs") == "true", regions)


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("spliceloom_bam").options(**options).load(path)


ENTRY_SCHEMA = "path string, base long, rname string, contig int, interval boolean, slot int, begin long, end long"


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """The indexes' chunks (slot is their bin) and intervals (slot is their number, begin their place), of all files of a path.

    A file without index has one entry without rname, which stands for all of it.
    """
    files, base = [], 0
    for name, size in bam_files(path):
        files.append((name, base))
        base += size

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for name, before in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                if (index := read_index(name)) is None:
                    rows.append((name, before, None, -1, False, -1, None, None))
                else:
                    for k, (rname, contig) in enumerate(zip(_contigs(_Stream(name), name), parse_index(index))):
                        rows += [(name, before, rname, k, False, b, *chunk) for b, chunks in contig.bins.items() for chunk in chunks]
                        rows += [(name, before, rname, k, True, n, place, None) for n, place in enumerate(contig.intervals) if place]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in ENTRY_SCHEMA.split(", ")])

    table = spark.createDataFrame(files, "path string, base long").repartition(min(len(files), spark.sparkContext.defaultParallelism * 4))
    return table.mapInArrow(run, ENTRY_SCHEMA)


def bins_of(start: Column, end: Column) -> Column:
    """All bins that may hold records over positions from ``start`` to before ``end`` (from 0)."""
    last = F.greatest(end - 1, start)
    return F.flatten(F.array(*[F.sequence(F.lit(first) + F.shiftright(start, bits), F.lit(first) + F.shiftright(last, bits)) for first, bits in LEVELS]))


def wanted_chunks(entries: DataFrame, loci: DataFrame) -> DataFrame:
    """Disjoint ranges of places that hold all records over the loci (rname, start, end; half open from 0).

    Columns: path, base, begin, end, and ``low`` and ``high`` (contig, position) between which the loci lie. Chunks of
    different bins may share a block of the file, so those that overlap become one.
    """
    start = F.greatest(F.col("start").cast("long"), F.lit(0))
    spots = loci.select("rname", start.alias("start"), F.col("end").cast("long").alias("end")).where("rname IS NOT NULL")
    spots = spots.withColumn("window", F.shiftright("start", INTERVAL_BITS)).withColumn("slot", F.explode(bins_of(F.col("start"), F.col("end"))))
    spots = spots.groupBy("rname", "slot", "window").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    chunks = entries.where("rname IS NOT NULL AND NOT interval").drop("interval")
    intervals = entries.where("interval").select("path", "rname", F.col("slot").cast("long").alias("window"), F.col("begin").alias("least"))
    met = chunks.withColumnRenamed("end", "stop").withColumn("slot", F.col("slot").cast("long")).join(spots, ["rname", "slot"]).join(intervals, ["path", "rname", "window"], "left")
    met = met.withColumn("least", F.coalesce("least", F.lit(0))).where(F.col("stop") > F.col("least"))
    spot = lambda c: F.struct("contig", c)
    met = met.groupBy("path", "base", "begin", "stop").agg(F.min("least").alias("least"), F.min(spot("start")).alias("low"), F.max(spot("end")).alias("high"))
    met = met.withColumn("begin", F.greatest("begin", "least")).drop("least")
    # The chunks of one file's index are few enough to be laid out in order by one task.
    order = Window.partitionBy("path").orderBy("begin", "stop")
    merged = met.withColumn("reached", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    merged = merged.withColumn("island", F.sum((F.col("reached").isNull() | (F.col("begin") >= F.col("reached"))).cast("long")).over(order))
    merged = merged.groupBy("path", "base", "island").agg(F.min("begin").alias("begin"), F.max("stop").alias("end"), F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.select("path", "base", "begin", "end", F.col("low.contig").alias("low_contig"), F.col("low.start").alias("low"), F.col("high.contig").alias("high_contig"), F.col("high.end").alias("high"))


def read_bam_at(spark: SparkSession, path: str, loci: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """Alignments that may lie over loci (rname, start, end; half open from 0), each once; a few of their neighbours come with them.

    Tasks exist only for chunks whose bins meet a locus, about ``split_bytes`` of compressed bytes each. Files without
    index are read whole, one task each.
    """
    entries = stage_table(index_entries(spark, path), "bam-index")
    whole = entries.where("rname IS NULL").select("path", "base", "begin", "end", *[F.lit(None).cast("long").alias(c) for c in ("low_contig", "low", "high_contig", "high")])
    wanted = stage_table(wanted_chunks(entries, loci).unionByName(whole), "bam-chunks")
    size = F.when(F.col("end").isNull(), F.lit(split_bytes)).otherwise(F.shiftright("end", 16) - F.shiftright("begin", 16) + (1 << 16))
    total, rows = wanted.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(rows, -(-total // split_bytes)))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: dict[str, list[str]] = {}

        def rows() -> Iterator[tuple]:
            for batch in found:
                for name, base, begin, end, low_contig, low, high_contig, high in zip(*(c.to_pylist() for c in batch.columns)):
                    bounds = (None, None) if low is None else ((low_contig, low), (high_contig, high))
                    yield from decode_bam(Piece(name, base, begin, end, *bounds), headers)

        yield from batches(rows())

    return wanted.repartition(tasks, "path", "begin").mapInArrow(run, SCHEMA)
