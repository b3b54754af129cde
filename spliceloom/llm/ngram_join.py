"""Exact Jaccard self-join on word n-grams by universe partition.

Method. Two sets with similarity t or more differ in at most
H = (1-t)/(1+t) * (sum of sizes) elements. For each level of sizes, hashing deals the
universe to H+1+z slots; a segment is one slot (its content must be equal) or two
slots (equal up to one deletion), so a pair of a level that passes has more than
z slots' worth of agreeing segments. A set may then leave out up to z empty
segments, which would otherwise agree with everyone's. How many segments take
two slots is chosen per level by cost: an equal-content segment is one key, a
one-deletion segment one per element, but the first agrees by chance far more
often, which counts as the level's sets grow in number.

Sets that share a key are compared by parity bitmaps: the number of unequal bits
bounds the difference from below, so rejecting is exact. The pairs that stay,
reduced to a spanning forest in each group, make families. The sets of a family
meet in one task, or part by part, and are verified there on their words, closest
first; pairs that are connected already need no check. So no link between
components is lost, and no group is expanded into pairs.

Large groups and families are compared star-wise first: each part within itself
and with one hub. What is then in the group's largest component needs no more
comparison among itself; only the rest is compared with all parts. A set is
copied as often as that rest has parts.

Hashes of words and n-grams only find candidates. Links are decided on the words,
and texts are one class if they agree in a 128-bit cryptographic digest of their
words; classes have numbers, which are the digest's first bytes or, where two
digests share those, others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialize
from .graph import components, runs
from .shingles import exact_sets, mix, ngrams, plain_words, word_hashes

RATIO = 1.6  # sizes of a level; near the least number of keys for t from 0.8 to 0.9
#: Words of bitmaps compared at once.
_AT_ONCE = 1 << 17
_C1, _C2, _C3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


@dataclass(frozen=True)
class Level:
    number: int
    slots: int
    exact: int  # segments of one slot; the others take two
    spare: int  # empty segments that a set may leave out


@dataclass(frozen=True)
class Rule:
    """Similarity ``part``/``whole`` or more."""

    part: int
    whole: int

    def links(self, common: int, a: int, b: int) -> bool:
        return self.whole * common >= self.part * (a + b - common)

    def most_apart(self, total: int) -> int:
        """Largest difference of two sets whose sizes sum to ``total``."""
        return (self.whole - self.part) * total // (self.whole + self.part)

    def least_partner(self, n: int) -> int:
        return -(-self.part * n // self.whole)

    def edges(self, number: int) -> tuple[int, int]:
        """Sizes of a level: from, and below."""
        return math.ceil(RATIO**number), math.ceil(RATIO ** (number + 1))

    def levels_of(self, n: int) -> list[int]:
        """Levels of the larger set of a pair in which a set of size ``n`` can take part."""
        own = max(0, int(math.log(n) / math.log(RATIO)) - 1)
        while self.edges(own)[1] <= n:
            own += 1
        return [own] + [own + 1] * (n >= self.least_partner(self.edges(own + 1)[0]))


def empty_segments(n: int, slots: int, exact: int, spare: int) -> tuple[float, float]:
    """For a set of size ``n``: the share of its one-slot segments that are empty, and the chance that more than ``spare`` are."""
    share = (1 - 1 / slots) ** n
    mean = exact * share
    spread = math.sqrt(max(0.0, mean + exact * (exact - 1) * (1 - 2 / slots) ** n - mean**2))
    over = spare + 0.5 - mean
    return share, math.erfc(over / spread / math.sqrt(2)) / 2 if spread else float(over < 0)


def plan_level(rule: Rule, number: int, sets: int) -> Level:
    """Allocation of a level that ``sets`` sets take part in, of least expected cost.

    A set with more empty segments than it may leave out sends all of them, and they agree with those of every other
    such set. The smallest sets of a level have the most, so the spare slots are chosen by sets of all its sizes.
    """
    low, top = rule.edges(number)[0], rule.edges(number)[1] - 1
    need = rule.most_apart(2 * top) + 1
    least = min(rule.least_partner(low), top)
    sizes = [round(least * (top / least) ** (k / 8)) for k in range(9)]
    best = None
    for pairs in sorted({0, need // 8, need // 4, need // 2}):
        exact = need - 2 * pairs
        for spare in sorted({math.ceil(need * k / 40) for k in range(81)}) if exact and need > 1 else [0]:
            slots, per = need + spare, top / (need + spare)
            empty = [empty_segments(n, slots, exact + spare, spare) for n in sizes] if exact else [(0.0, 0.0)]
            sent = sum(share * chance for share, chance in empty) / len(empty)
            filled = sum(1 - share for share, _ in empty) / len(empty)
            keys = (exact + spare) * filled + pairs * (1 + 2 * per)
            # A member of a group of empty segments is sent on with its bitmap, and a comparison there is cheaper than a key.
            chance = (exact + spare) * sent * (4 + sets * sent / 16) + sets * pairs * ((1 + 2 * per) * math.exp(-2 * per)) ** 2
            if best is None or keys + chance < best[0]:
                best = (keys + chance, Level(number, slots, exact + spare, spare))
    return best[1]


@lru_cache(maxsize=256)
def segment_tags(level: Level) -> np.ndarray:
    """A number for each segment of a level."""
    n = level.exact + (level.slots - level.exact) // 2
    return mix(np.arange(n, dtype=np.uint64) * _C3 + np.uint64(level.number))


def segment_keys(items: np.ndarray, level: Level) -> np.ndarray:
    """Keys of a set's segments."""
    values, tags = mix(items * _C1 + np.uint64(level.number)), segment_tags(level)
    segment = ((values >> np.uint64(33)) % np.uint64(level.slots)).astype(np.int64)
    wide = len(tags) > level.exact
    if wide:
        segment = np.where(segment < level.exact, segment, level.exact + (segment - level.exact) // 2)
    parts = mix(values ^ _C2)
    sums, kept = np.zeros(len(tags), dtype=np.uint64), np.zeros(len(tags), dtype=bool)
    np.add.at(sums, segment, parts)
    kept[segment] = True
    kept[level.exact :] = True
    if len(tags) - np.count_nonzero(kept) > level.spare:
        kept[:] = True
    keys = [mix(sums[kept] + tags[kept])]
    if wide:
        inner = segment >= level.exact
        keys.append(mix(sums[segment[inner]] - parts[inner] + tags[segment[inner]]))
    return np.concatenate(keys)


def parity_bitmap(items: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the number of elements that hash to k; a power of two of bits, at least as many as elements."""
    n = max(256, 1 << int(len(items) - 1).bit_length())
    bits = (mix(items ^ _C3) >> np.uint64(17)).astype(np.int64) & (n - 1)
    return np.packbits((np.bincount(bits, minlength=n) & 1).astype(np.uint8)).view(np.uint64)


def near_pairs(sizes: np.ndarray, bitmaps: list[np.ndarray], side: np.ndarray, crossed: bool, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """For each set that has some, the ones not smaller (of the other side, if ``crossed``) that may link with it, closest first.

    Of two bitmaps the longer is folded to the shorter's length: its halves are
    combined, which again gives parities. Unequal bits bound the difference, and
    those of a quarter of the words already rule most pairs out.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, side, bitmaps = sizes[order], side[order], [bitmaps[k] for k in order.tolist()]
    widths = np.array([len(b) for b in bitmaps])
    for width in np.unique(widths).tolist():
        begin = int(np.searchsorted(widths, width))
        own_end = int(np.searchsorted(widths, width, side="right"))
        largest = sizes[own_end - 1] * rule.whole // rule.part
        end = int(np.searchsorted(sizes, largest, side="right"))
        folded = []
        for b in bitmaps[begin:end]:
            while len(b) > width:
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            folded.append(b)
        matrix = np.stack(folded)
        first = max(1, width // 4)
        i = begin
        while i < own_end:
            # Several sets at once, as the work for one is mostly calls.
            rows = max(1, _AT_ONCE // (max(1, end - i - 1) * first))
            rows = slice(i, min(own_end, i + rows))
            i = rows.stop
            own, others = np.arange(rows.start, rows.stop), np.arange(rows.start + 1, end)
            bound = (rule.whole - rule.part) * (sizes[own, None] + sizes[None, others]) // (rule.whole + rule.part)
            some = np.bitwise_count(matrix[own - begin, None, :first] ^ matrix[None, others - begin, :first]).sum(axis=2) <= bound
            some &= (others > own[:, None]) & (sizes[others] <= sizes[own, None] * rule.whole // rule.part)
            if crossed:
                some &= side[others] != side[own, None]
            at, to = np.nonzero(some)
            if not len(at):
                continue
            a, b = own[at], others[to]
            apart = np.concatenate([np.bitwise_count(matrix[a[k : k + n] - begin] ^ matrix[b[k : k + n] - begin]).sum(axis=1) for n in [max(1, _AT_ONCE // width)] for k in range(0, len(a), n)])
            ok = apart <= bound[at, to]
            a, b, apart = a[ok], b[ok], apart[ok]
            closest = np.lexsort((apart, a))
            a, b = a[closest], b[closest]
            edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))).tolist() if len(a) else []
            for x, y in zip(edges, [*edges[1:], len(a)]):
                yield int(order[a[x]]), order[b[x:y]]


def set_of(words: np.ndarray, n: int) -> np.ndarray:
    grams = np.sort(ngrams(words, n))
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    return grams[new]


def digest_of(words: list[bytes]) -> bytes:
    """Digest of a text's words; texts of equal digest are one class."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _number(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "little", signed=True) >> (64 - bits)


def describe(rows: DataFrame, n: int, bits: int) -> DataFrame:
    """(id, size, class, digest, bitmap) of each row of (id, text); an empty set has no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bitmaps = [], [], []
            for text, words in zip(batch.column(1), word_hashes(batch.column(1))):
                items = set_of(words, n)
                sizes.append(len(items))
                digests.append(digest_of(plain_words(text.as_py())) if len(items) else None)
                bitmaps.append(parity_bitmap(items).tobytes() if len(items) else None)
            classes = [None if d is None else _number(d, bits) for d in digests]
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "size", "class", "digest", "bitmap"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, size long, class long, digest binary, bitmap binary")


def gather(table: DataFrame) -> DataFrame:
    """One row of each class: (class, id, size, bitmap, alone); not ``alone`` if several digests have its number."""
    grouped = table.where("class IS NOT NULL").groupBy("class")
    found = grouped.agg(
        F.min("id").alias("id"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), (F.min("digest") == F.max("digest")).alias("alone")
    )
    return materialize(found, "join-classes")


def renumbered(table: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, dict[bytes, int]]:
    """Table and classes with a number of its own for every digest, and the numbers that aren't the digest's first bytes.

    Of n digests about n * n / 2**65 pairs share a number, so a handful even among 10**10.
    """
    moved: dict[bytes, int] = {}
    while not is_empty(classes.where("NOT alone")):
        shared = classes.where("NOT alone").select("class")
        for k, row in enumerate(table.join(F.broadcast(shared), "class").select("digest").distinct().sort("digest").collect()):
            salted = bytes(row.digest) + len(moved).to_bytes(8, "little") + bytes([k % 256])
            moved[bytes(row.digest)] = _number(hashlib.blake2b(salted, digest_size=16).digest(), 64)
        changes = table.sparkSession.createDataFrame([(bytearray(d), c) for d, c in moved.items()], "digest binary, moved long")
        fresh = table.join(F.broadcast(changes), "digest", "left").withColumn("class", F.coalesce("moved", "class"))
        table = materialize(fresh.select(table.columns), "join-sets")
        classes = gather(table)
    return table, classes, moved


def keyed(rows: DataFrame, n: int, rule: Rule, levels: dict[int, Level], bits: int, moved: dict[bytes, int]) -> DataFrame:
    """(key, class): equal sets of a task are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keys: list[np.ndarray] = []
        classes: list[int] = []

        def rows() -> pa.RecordBatch:
            arrays = [np.concatenate(keys).view(np.int64), np.repeat(np.array(classes, dtype=np.int64), [len(k) for k in keys])]
            keys.clear()
            classes.clear()
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "class"])

        held = 0
        for batch in batches:
            for text, words in zip(batch.column(0), word_hashes(batch.column(0))):
                if not len(words) or (d := digest_of(plain_words(text.as_py()))) in seen:
                    continue
                seen.add(d)
                items = set_of(words, n)
                for number in rule.levels_of(len(items)):
                    keys.append(segment_keys(items, levels[number]))
                    classes.append(moved.get(d, _number(d, bits)))
                    held += len(keys[-1])
                if held > 100_000:
                    yield rows()
                    held = 0
        if keys:
            yield rows()

    return rows.select("text").mapInArrow(run, "key long, class long")


def group_parts(keys: DataFrame, most: int) -> DataFrame:
    """(key, part, members, digest) of keys that several classes share, in parts of ``most`` members.

    A class that several tasks sent is in a part once, but may be in several parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, parts = None, [], 0
        out: list[tuple[int, int, list[int]]] = []

        def rows() -> pa.RecordBatch:
            digests = [int(mix(np.array(m, dtype=np.int64).view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) for _, _, m in out]
            arrays = [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int32()),
                pa.array([x[2] for x in out], pa.list_(pa.int64())),
                pa.array(digests, pa.int64()),
            ]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["key", "part", "members", "digest"])

        def close() -> None:
            if len(held) > 1 or (parts and held):
                out.append((held_key, parts, held))

        for batch in batches:
            key, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
            ends = np.append(begins[1:], len(key))
            # Most keys belong to one class alone.
            shared = np.flatnonzero(ends - begins > 1).tolist()
            edge = [0, len(begins) - 1] if len(begins) else []
            for g in sorted({*shared, *edge}):
                a, b = begins[g], ends[g]
                k, members = int(key[a]), sorted(set(member[a:b].tolist()))
                if held_key is not None and k == held_key:
                    held = sorted({*held, *members})
                else:
                    close()
                    held_key, held, parts = k, members, 0
                while len(held) > most:
                    out.append((held_key, parts, held[:most]))
                    held, parts = held[most:], parts + 1
            if out:
                yield rows()
        if held_key is not None:
            close()
            if out:
                yield rows()

    ordered = keys.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key long, part int, members array<long>, digest long")


def star(groups: DataFrame, most: int) -> DataFrame:
    """Rows of (group, class) with the group's number of parts, the row's part, and the group's hub."""
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / most).alias("parts"), F.min("class").alias("hub"))
    return groups.join(sizes, "group").withColumn("part", F.expr("pmod(xxhash64(class, 11), parts)"))


def connect(small: DataFrame, large: DataFrame, most: int, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect, within each group, all the classes that links of the group connect.

    ``small`` is (tile, class), ``large`` what ``star`` gives. ``links_of`` finds
    links in tiles (tile, side, crossed, label, class): within a tile, or between
    its sides if ``crossed``; classes of one label are connected already.
    """
    none = [F.lit(0).alias("side"), F.lit(False).alias("crossed"), F.lit(None).cast("long").alias("label")]
    inner = large.select(F.xxhash64("group", "part").alias("tile"), "class")
    hubs = large.where("parts > 1").select("group", "hub", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")).distinct()
    hubs = hubs.select(F.xxhash64("group", "part").alias("tile"), F.col("hub").alias("class"))
    first = small.select("tile", "class").unionByName(inner.unionByName(hubs)).select("tile", *none, "class")
    links = materialize(links_of(first), "join-star")
    if is_empty(large.where("parts > 1")):
        return links
    large = large.where("parts > 1")
    labels = components(links).select(F.col("node").alias("class"), F.col("component").alias("label"))
    rows = large.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    rows = materialize(rows.select("group", "class", "part", "parts", "label"), "join-large")
    counts = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    loose = rows.join(main, "group").where("label <> main").drop("main")
    sizes = loose.groupBy("group").agg(F.ceil(F.count("*") / most).alias("blocks"))
    loose = loose.join(sizes, "group").withColumn("block", F.expr("pmod(xxhash64(class, 13), blocks)"))
    loose = loose.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    every = rows.join(sizes, "group").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    tile = F.xxhash64("group", "block", "part").alias("tile")
    sides = [x.select(tile, F.lit(k).alias("side"), F.lit(True).alias("crossed"), "label", "class") for k, x in enumerate((every, loose))]
    return links.unionByName(links_of(sides[0].unionByName(sides[1])))


def group_tiles(parts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Groups of ``group_parts`` as ``connect`` takes them: those in one part, the same members once, and larger ones."""
    large = parts.join(parts.where("part = 1").select("key"), "key", "left_semi")
    small = parts.where("part = 0").join(parts.where("part = 1").select("key"), "key", "left_anti")
    small = small.groupBy("digest").agg(F.min(F.struct("key", "members")).alias("g"))
    small = small.select(F.xxhash64("digest").alias("tile"), F.explode("g.members").alias("class"))
    return small, star(large.select(F.col("key").alias("group"), F.explode("members").alias("class")).distinct(), most)


def spanning(near: Iterator[tuple[int, np.ndarray]], label: np.ndarray, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among those of ``near_pairs``; rows of one label are joined before."""
    found, apart = [], len(np.unique(label)) - 1
    if not apart:
        return found
    for i, others in near:
        while len(others := others[label[others] != label[i]]):
            j, others = int(others[0]), others[1:]
            if linked(i, j):
                label[label == label[j]] = label[i]
                found.append((i, j))
        if len(found) == apart:
            break
    return found


def _links(frame: DataFrame, links: Callable[[pa.RecordBatch, np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) of all tiles of ``frame``; ``links`` gets a tile and what its classes are labelled, and returns rows of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in runs(batches, "tile"):
            ids = group.column("class").to_numpy()
            labels = group.column("label")
            label = labels.to_numpy().copy() if not labels.null_count else pc.coalesce(labels, group.column("class")).to_numpy().copy()
            out += [(int(ids[i]), int(ids[j])) for i, j in links(group, label)]
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return frame.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def candidates(tiles: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): a spanning forest, in each tile, of the pairs whose bitmaps allow a link."""

    def links(group: pa.RecordBatch, label: np.ndarray) -> list[tuple[int, int]]:
        sizes, side = group.column("size").to_numpy(), group.column("side").to_numpy()
        bitmaps = [np.frombuffer(v, dtype=np.uint64) for v in group.column("bitmap").to_pylist()]
        return spanning(near_pairs(sizes, bitmaps, side, group.column("crossed")[0].as_py(), rule), label, lambda i, j: True)

    return _links(tiles.join(classes.select("class", "size", "bitmap"), "class"), links)


def verified(tiles: DataFrame, sets: DataFrame, n: int, rule: Rule) -> DataFrame:
    """(a, b): links that connect the sets of each tile, decided on the words of ``sets`` (class, words)."""

    def links(group: pa.RecordBatch, label: np.ndarray) -> list[tuple[int, int]]:
        items = exact_sets(group.column("words").to_pylist(), n)
        sizes, side = np.array([len(x) for x in items]), group.column("side").to_numpy()

        def linked(i: int, j: int) -> bool:
            common = sizes[i] + sizes[j] - len(np.union1d(items[i], items[j]))
            return rule.links(int(common), int(sizes[i]), int(sizes[j]))

        near = near_pairs(sizes, [parity_bitmap(x) for x in items], side, group.column("crossed")[0].as_py(), rule)
        return spanning(near, label, linked)

    return _links(tiles.join(sets.select("class", "words"), "class"), links)


def sets_of(rows: DataFrame, wanted: DataFrame, bits: int, moved: dict[bytes, int]) -> DataFrame:
    """(id, class, words) of the wanted ids and few others, by reading those texts again.

    A bitmap of fixed size (128 KB) of hashed ids leaves most other texts out.
    """
    slots = 1 << 20
    slot = F.expr(f"pmod(xxhash64(id), {slots})")
    words = wanted.select(slot.alias("s")).groupBy(F.expr("s div 32768").alias("w"))
    filled = words.agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits")).collect()
    bitmap = np.zeros(slots // 8, dtype=np.uint8)
    for r in filled:
        bitmap[r.w * 4096 : (r.w + 1) * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(shared.value, bitorder="little")
        for batch in batches:
            batch = batch.filter(pa.array(marked[batch.column(2).to_numpy()] == 1))
            plain = [plain_words(text.as_py()) for text in batch.column(1)]
            digests = [digest_of(w) if w else None for w in plain]
            classes = pa.array([None if d is None else moved.get(d, _number(d, bits)) for d in digests], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), classes, pa.array([b" ".join(w) for w in plain], pa.binary())], ["id", "class", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", slot.alias("slot")).mapInArrow(run, f"id {kind}, class long, words binary")


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    part: int = 80,
    whole: int = 100,
    class_bits: int = 64,
    most: int = 1024,
) -> DataFrame:
    """Components of the links between texts whose word n-gram sets are ``part``/``whole`` similar or more.

    Words are runs of characters other than white space, A-Z lower-cased; fewer
    than ``n`` words are one n-gram. Returns one row per input row: the id column,
    n_shingles, class_id (a number for equal words) and component_id, the smallest
    id reachable by links, its own included. ``class_bits`` of a digest number the
    classes, and digests that share them get others. ``most`` members of a group
    are compared on their words in one task, and four times as many on their bitmaps.

    Null or empty texts have no n-grams and link with nothing, not even with each
    other. Ids must be integers; a null id reaches its component's smallest other
    id, or null. Rows that repeat a text are one class. No rows give no rows.
    Other columns are not read, whatever their names.
    """
    rule = Rule(part, whole)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = materialize(describe(rows, n, class_bits), "join-sets")
    table, classes, moved = renumbered(table, gather(table))

    # One row per size: a number of rows that grows with the longest text only.
    sizes = classes.groupBy("size").agg(F.count("*").alias("n")).collect()
    population: dict[int, int] = {}
    for r in sizes:
        for number in rule.levels_of(r.size):
            population[number] = population.get(number, 0) + r.n
    levels = {number: plan_level(rule, number, sets) for number, sets in population.items()}

    # A task holds more bitmaps than texts: a class has a bit or two for each n-gram here, but all its words when it is verified.
    bitmaps = 4 * most
    parts = materialize(group_parts(keyed(rows, n, rule, levels, class_bits, moved), bitmaps), "join-groups")
    families = components(connect(*group_tiles(parts, bitmaps), bitmaps, lambda t: candidates(t, classes, rule)))
    families = families.select(F.col("node").alias("class"), F.col("component").alias("group"))
    families = materialize(families.join(classes.select("class", "id"), "class"), "join-families")
    wanted = families.select("class", F.col("id").alias("wanted"))
    sets = sets_of(rows.where("id IS NOT NULL"), families.where("id IS NOT NULL"), class_bits, moved).join(wanted, "class").where("id = wanted")
    if not is_empty(families.where("id IS NULL")):
        # Nothing but the class tells rows without id apart.
        unnumbered = sets_of(rows.where("id IS NULL"), families.where("id IS NULL"), class_bits, moved)
        sets = sets.unionByName(unnumbered.join(wanted, "class").where("wanted IS NULL"))
    # Of rows that repeat id and words, one stays.
    sets = sets.select("class", "words").dropDuplicates(["class"])
    nothing = families.select(F.col("group").alias("tile"), "class").limit(0)
    found = connect(nothing, star(families.drop("id"), most), most, lambda t: verified(t, sets, n, rule))
    found = components(found).withColumnRenamed("node", "class")

    labelled = classes.select("class", "id").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = materialize(labelled, "join-labelled")
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = labelled.join(least, "component").select("class", "component_id")
    out = table.drop("bitmap", "digest").join(by_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("class").alias("class_id"), component.alias("component_id"))
