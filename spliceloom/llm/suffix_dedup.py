"""Removal of repeated byte strings with suffix arrays.

Method. Every window of ``length`` bytes has an owner, the least of its gram
hashes, which depends on the window alone. A run of windows with one owner is a
stretch. Equal windows have equal owners at equal offsets, so:

* a stretch whose bytes occur again as a stretch is repeated as a whole;
* a stretch whose owner's gram occurs nowhere else has no repeated window;
* the others are compared with the stretches of the same gram. A shard joins
  distinct stretches to one text of 16-byte symbols, aligned at the owners, and
  builds its suffix array by linear grouping (see ``suffixes``). Neighbours that
  agree on 11 symbols form a run, and windows in a run are equal if the bytes
  before and after those symbols are.

Grams with very many distinct stretches (the edges of a passage that many
documents share) would fill a shard; their windows are counted one by one by
digest, summed in each block before the shuffle. So no group is bounded by
dropping anything, and hot passages are one entry a block.

Stretches and windows are equal if their 128-bit cryptographic digests are;
symbols and what surrounds them are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_texts, bucket_bits, cuts, distinct_pairs, pack_blocks, planes, unplanes
from .common import materialize
from .graph import runs
from .suffixes import suffix_array
from .windows import digests, stretches

SYMBOL = 16
REPEATED, UNSURE, MANY = 1, 2, 4


class Stretches:
    """Stretches of a block's texts, and the distinct ones sorted by gram."""

    def __init__(self, texts: bytes, length: int) -> None:
        column = block_texts(texts)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        self.raw = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        found = [stretches(r, length) for r in self.raw]
        self.doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        self.first, self.last, self.own, self.gram, self.whole = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((self.whole[:, 1], self.whole[:, 0], self.gram))
        gram, whole = self.gram[order], self.whole[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]).any(axis=1)
        begins = np.flatnonzero(new)
        self.sample = order[begins]  # one stretch of each distinct one
        self.distinct_gram, self.distinct_whole = gram[begins], whole[begins]
        self.counts = np.diff(np.append(begins, len(order))).astype(np.uint32)
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1


def _blobs(block: int, keys: np.ndarray, columns: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """(bucket, block, key steps, column planes...) of sorted keys."""
    at = cuts(keys, bits)
    for b in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[b], at[b + 1])
        yield b, block, planes(np.diff(keys[part], prepend=np.uint64(0))), *(planes(np.ascontiguousarray(c[part])) for c in columns)


def send_stretches(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0), batch.column(1)):
                s = Stretches(texts.as_py(), length)
                rows = list(_blobs(block.as_py(), s.distinct_gram, [*s.distinct_whole.T, s.counts], bits))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                names = ["bucket", "block", "grams", "wholes", "more", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return blocks.select("block", "texts").mapInArrow(send, "bucket int, block long, grams binary, wholes binary, more binary, counts binary")


def answer_stretches(sent: DataFrame, crowd: int) -> DataFrame:
    """(block, bucket, flags): what is known of each stretch, in the order in which the block asked."""

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(unplanes(h.as_py(), "<u8"), dtype=np.uint64) for h in table["grams"]]
        gram = np.concatenate(asked)
        whole, more = (np.concatenate([unplanes(w.as_py(), "<u8") for w in table[c]]) for c in ("wholes", "more"))
        count = np.concatenate([unplanes(c.as_py(), "<u4") for c in table["counts"]]).astype(np.int64)
        order = np.lexsort((more, whole, gram))
        g, w, m = gram[order], whole[order], more[order]
        new_gram = np.concatenate(([True], g[1:] != g[:-1]))
        new = new_gram | np.concatenate(([True], (w[1:] != w[:-1]) | (m[1:] != m[:-1])))
        total = np.bincount(np.cumsum(new) - 1, weights=count[order])[np.cumsum(new) - 1]
        kinds = np.bincount(np.cumsum(new_gram) - 1, weights=new)[np.cumsum(new_gram) - 1]
        flags = np.empty(len(order), dtype=np.uint8)
        flags[order] = REPEATED * (total > 1) + UNSURE * ((kinds > 1) & (kinds <= crowd)) + MANY * (kinds > crowd)
        parts = np.split(flags, np.cumsum([len(a) for a in asked])[:-1])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "flags": pa.array([p.tobytes() for p in parts], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(answer, "block long, bucket int, flags binary")


#: Rows that a block sends after the first answers. kind 0: what it knows (a, b, c: documents, begins and
#: ends of repeated ranges). kind 1: a stretch to compare (number: its gram, doc, at: first window and owner,
#: a: bytes, c: its hash, flag: whether it is repeated). kind 2: digests of windows to count (bucket, a: steps
#: of first numbers, b: weights, c: second numbers). kind 3: documents and begins of those windows, and their places
#: among the distinct digests.
SCHEMA = "kind int, block long, bucket int, number long, doc long, at long, owner long, flag boolean, a binary, b binary, c binary"
_FIELDS = ["kind", "block", "bucket", "number", "doc", "at", "owner", "flag", "a", "b", "c"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]


def _row(kind: int, block: int, bucket=0, number=0, doc=0, at=0, owner=0, flag=False, a=b"", b=b"", c=b"") -> tuple:
    return kind, block, bucket, number, doc, at, owner, flag, a, b, c


def resolve(blocks: DataFrame, answers: DataFrame, length: int, bits: int) -> DataFrame:
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left["block"][0].as_py()
        s = Stretches(left["texts"][0].as_py(), length)
        flags = np.frombuffer(b"".join(f.as_py() for f in right.sort_by("bucket")["flags"]), dtype=np.uint8)
        mine = flags[s.entry]
        known = np.flatnonzero(mine & REPEATED)
        rows = [_row(0, block, a=planes(s.doc[known]), b=planes(s.first[known]), c=planes(s.last[known] + length))]
        for e in np.flatnonzero(flags & UNSURE).tolist():
            i = s.sample[e]
            rows.append(
                _row(
                    1,
                    block,
                    number=int(s.gram[i : i + 1].view(np.int64)[0]),
                    doc=int(s.doc[i]),
                    at=int(s.first[i]),
                    owner=int(s.own[i]),
                    flag=bool(flags[e] & REPEATED),
                    a=s.raw[s.doc[i]][s.first[i] : s.last[i] + length].tobytes(),
                    c=s.whole[i : i + 1].tobytes(),
                )
            )
        hot = s.sample[np.flatnonzero(flags & MANY)]
        if len(hot):
            found = []
            for i in hot.tolist():
                part = s.raw[s.doc[i]][s.first[i] : s.last[i] + length]
                begins = np.arange(len(part) - length + 1)
                found.append(digests(part, begins, begins + length))
            sizes = [len(h) for h in found]
            weights = np.repeat(np.where(flags[s.entry[hot]] & REPEATED, 2, 1), sizes)
            one, two, place = distinct_pairs(*np.concatenate(found).T)
            summed = np.bincount(place, weights=weights).astype(np.uint32)
            rows += [_row(2, block, bucket=k, a=steps, b=w, c=more) for k, _, steps, w, more in _blobs(block, one, [summed, two], bits)]
            starts = np.concatenate([s.first[i] + np.arange(n) for i, n in zip(hot.tolist(), sizes)])
            rows.append(_row(3, block, a=planes(np.repeat(s.doc[hot], sizes)), b=planes(starts), c=planes(place.astype(np.int64))))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_FIELDS)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, SCHEMA)


def _numbered(rows: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, equal for equal rows and in their order; 8 bytes are compared at a time."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), dtype=np.uint8)
    wide[:, : rows.shape[1]] = rows
    lanes = wide.view(">u8").astype(np.uint64).T
    order = np.lexsort(lanes[::-1])
    new = np.zeros(len(rows), dtype=np.int64)
    new[1:] = (lanes[:, order[1:]] != lanes[:, order[:-1]]).any(axis=0)
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.cumsum(new)
    return place


def repeated_windows(texts: list[bytes], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """Per text, which of its windows occur in another one; owners are offsets in the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    # Whole symbols of each text, aligned at its owner, and a separator after each text.
    lead = owner % SYMBOL
    n_symbols = (sizes - lead) // SYMBOL
    text_of = np.repeat(np.arange(len(texts)), n_symbols + 1)
    begin = np.cumsum(n_symbols + 1) - (n_symbols + 1)
    step = np.arange(len(text_of)) - begin[text_of]
    inside = step < n_symbols[text_of]
    byte = base[text_of] + lead[text_of] + SYMBOL * step
    symbols = np.zeros(len(text_of), dtype=np.int64)
    symbols[inside] = _numbered(raw[byte[inside][:, None] + np.arange(SYMBOL)]) + 1

    order = np.array(suffix_array(symbols), dtype=np.int64)
    core = (length - SYMBOL + 1) // SYMBOL  # symbols that any window holds whole
    order = order[step[order] + core <= n_symbols[text_of[order]]]
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(core):
        same &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    run = np.cumsum(np.concatenate(([True], ~same)))[: len(order)]
    shared = np.bincount(run)[run] > 1
    order, run = order[shared], run[shared]
    owner_text, start = text_of[order], byte[order] - base[text_of[order]]

    windows = sizes - length + 1
    first = np.cumsum(windows) - windows
    found = np.zeros(int(windows.sum()), dtype=bool)
    around = length - core * SYMBOL  # bytes of a window outside those symbols
    for before in range(SYMBOL):
        s = start - before
        ok = (s >= 0) & (s < windows[owner_text])
        if before > around or not ok.any():
            continue
        t, s, a, r = owner_text[ok], s[ok] + base[owner_text[ok]], byte[order[ok]], run[ok]
        outside = np.concatenate((s[:, None] + np.arange(before), (a + core * SYMBOL)[:, None] + np.arange(around - before)), axis=1)
        place = _numbered(np.concatenate((raw[outside], r.astype("<u8")[:, None].view(np.uint8)), axis=1))
        n = np.bincount(place)
        found[(first[t] + s - base[t])[n[place] > 1]] = True
    return np.split(found, np.cumsum(windows)[:-1])


def compare_shards(rows: DataFrame, shards: int, length: int) -> DataFrame:
    """Stretches of equal grams, compared by suffix array; answers as rows of kind 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "shard"):
            unique = dict(zip(group.column("c").to_pylist(), range(len(group))))  # one of each repeated stretch
            group = group.take(pa.array(sorted(unique.values())))
            at, owner = group.column("at").to_numpy(), group.column("owner").to_numpy()
            found = repeated_windows(group.column("a").to_pylist(), owner - at, length)
            out: dict[int, list] = {}
            for i in np.flatnonzero(~np.array(group.column("flag").to_pylist())).tolist():
                hit = found[i]
                if not hit.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                begins, ends = edge[::2] + at[i], edge[1::2] - 1 + at[i] + length
                docs = np.full(len(begins), group.column("doc")[i].as_py(), dtype=np.int64)
                out.setdefault(group.column("block")[i].as_py(), []).append((docs, begins, ends))
            merged = [_row(0, block, **{k: planes(np.concatenate(c)) for k, c in zip("abc", zip(*parts))}) for block, parts in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in merged], t) for k, t in enumerate(_TYPES)], _FIELDS)

    dealt = rows.withColumn("shard", F.expr(f"pmod(xxhash64(number), {shards})"))
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(work, SCHEMA)


def count_windows(rows: DataFrame) -> DataFrame:
    """Windows counted by digest; answers as rows of kind 2 with flags in the order asked."""

    def work(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(unplanes(h.as_py(), "<u8"), dtype=np.uint64) for h in table["a"]]
        more = np.concatenate([unplanes(x.as_py(), "<u8") for x in table["c"]])
        _, _, place = distinct_pairs(np.concatenate(asked), more)
        weights = np.concatenate([unplanes(w.as_py(), "<u4") for w in table["b"]])
        flags = (np.bincount(place, weights=weights)[place] > 1).astype(np.uint8)
        parts = np.split(flags, np.cumsum([len(a) for a in asked])[:-1])
        done = [_row(2, block, bucket=table["bucket"][0].as_py(), a=p.tobytes()) for block, p in zip(table["block"].to_pylist(), parts)]
        return pa.table([pa.array([r[k] for r in done], t) for k, t in enumerate(_TYPES)], names=_FIELDS)

    return rows.groupBy("bucket").applyInArrow(work, SCHEMA)


def finish(blocks: DataFrame, answers: DataFrame, length: int, kind: str) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each document."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        column = block_texts(left["texts"][0].as_py())
        texts = [t.as_py().encode() for t in column]
        got = right.sort_by([("kind", "ascending"), ("bucket", "ascending")]).select(["kind", "a", "b", "c"]).to_pylist()
        ranges = [[unplanes(r[k], "<i8") for k in "abc"] for r in got if r["kind"] == 0]
        flags = np.frombuffer(b"".join(r["a"] for r in got if r["kind"] == 2), dtype=np.uint8)
        for r in (r for r in got if r["kind"] == 3):
            doc, begin, place = (unplanes(r[k], "<i8") for k in "abc")
            hit = flags[place] == 1
            ranges.append([doc[hit], begin[hit], begin[hit] + length])
        doc, begin, end = (np.concatenate(c) for c in zip(*ranges))
        order = np.argsort(doc, kind="stable")
        doc, begin, end = doc[order], begin[order], end[order]
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        removed, spans, digests, kept_texts = [], [], [], []
        for i, text in enumerate(texts):
            a, b = at[i], at[i + 1]
            kept, n_removed, n_spans = text, 0, 0
            if a < b:
                change = np.bincount(begin[a:b], minlength=len(text) + 1) - np.bincount(end[a:b], minlength=len(text) + 1)
                covered = np.cumsum(change)[:-1] > 0
                n_removed = int(covered.sum())
                n_spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(text, dtype=np.uint8)[~covered].tobytes()
            removed.append(n_removed)
            spans.append(n_spans)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
        return pa.table(
            {
                "id": left["ids"].combine_chunks().flatten(),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "kept": pa.array(kept_texts, pa.binary()),
            }
        )

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    block_bytes: int = 12_000_000,
    bits: int = 9,
    crowd: int = 512,
    shard_bytes: int = 3_000_000,
) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross documents and are judged on the
    input. Returns one row per input row: the id column, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes,
    which may cut a character). ``2**bits`` buckets, or as many as
    there are blocks, share the hashes of stretches;
    beyond ``crowd`` distinct stretches of a gram, windows are counted by digest.

    Null text counts as empty; texts shorter than ``length`` lose nothing. Rows
    that repeat a text lose all of it if it is long enough. No rows give no rows.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lit(True).alias("flag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = materialize(pack_blocks(rows, block_bytes), "suffix-blocks")
    bits = bucket_bits(blocks, bits)
    flags = materialize(answer_stretches(send_stretches(blocks, length, bits), crowd), "suffix-flags")
    known = materialize(resolve(blocks.select("block", "texts"), flags, length, bits), "suffix-known")
    unsure = known.where("kind = 1")
    total = unsure.select(F.sum(F.length("a"))).first()[0] or 0
    compared = compare_shards(unsure, max(1, -(-total // shard_bytes)), length)
    answers = known.where("kind IN (0, 3)").unionByName(compared).unionByName(count_windows(known.where("kind = 2")))
    answers = materialize(answers, "suffix-answers")
    return finish(blocks.select("block", "ids", "texts"), answers, length, kind).withColumnRenamed("id", id_col)
