"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Method. Both tokenizers encode a text once. Their token ends are marked in packed
bitsets over its bytes; AND gives the ends they share. Popcounts of words, summed
up, give the rank of any cut, so each shared cut maps to ranges of tokens on both
sides. A group is what lies between two shared cuts, and links are all pairs of a
group. Texts are laid end to end in chunks: a text's end is a shared cut itself.

How many documents hold an id pair is counted by Spark over all documents. There
are at most as many id pairs as products of two vocabularies, but that is too many
to broadcast: the ``FREQUENT`` most frequent ones are, and the others are joined.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .token_counts import SPLIT

#: Bytes of text that are aligned at a time; a longer text is aligned alone.
CHUNK = 1 << 21
#: Id pairs whose counts are broadcast (17 bytes each before hashing).
FREQUENT = 1 << 19
#: A group with more links than this is expanded by its distinct ids instead of its tokens.
WIDE = 1 << 16


@dataclass(frozen=True)
class Pieces:
    """The bytes of every token of a vocabulary, end to end."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Pieces:
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        return cls(np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens ``ids``, joined."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(total)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, for the letters from U+0100 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def load_byte_level(data: bytes):
    """Encoder and token bytes of a byte-level vocabulary whose ids are the ranks of its merges."""
    import tiktoken

    read = json.loads(data)
    special = {t["id"] for t in read["added_tokens"]}
    vocab, letters = read["model"]["vocab"], byte_letters()
    ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if k not in special}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        tokens[k] = token
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), Pieces.of(tokens)


@functools.lru_cache(maxsize=2)
def load_pieces(data: bytes):
    """Encoder and token bytes of a piece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return model, Pieces.of([bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)])


def bitset(places: np.ndarray, size: int) -> np.ndarray:
    """Words of 64 bits, of which those at ``places`` are set."""
    bits = np.zeros((size // 64 + 1) * 64, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Set bits up to each place, itself included."""
    counts = np.bitwise_count(words).astype(np.int64)
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
    return np.cumsum(counts)[word] - counts[word] + np.bitwise_count(words[word] & upto)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where tokens of both end, and the numbers of tokens of each up to there."""
    a, b = bitset(ends_a, size), bitset(ends_b, size)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return cuts, rank(a, cuts), rank(b, cuts)


def expand(na: np.ndarray, nb: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, A token and B token of every link of the groups."""
    links = na * nb
    group = np.repeat(np.arange(len(links)), links)
    at = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    return group, first_a[group] + at // nb[group], first_b[group] + at % nb[group]


def linked_pairs(ids_a, ids_b, na, nb, first_a, first_b, doc, width_b: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, id pair (A id times ``width_b`` plus B id) and its number of links, in order."""
    wide = np.flatnonzero(na * nb > WIDE)
    thin = np.flatnonzero(na * nb <= WIDE)
    group, a, b = expand(na[thin], nb[thin], first_a[thin], first_b[thin])
    keys, times = np.unique(doc[thin][group] * width + ids_a[a] * width_b + ids_b[b], return_counts=True)
    if len(wide):
        many, counts = [keys], [times]
        for g in wide:
            xs, x_times = np.unique(ids_a[first_a[g] : first_a[g] + na[g]], return_counts=True)
            ys, y_times = np.unique(ids_b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
            many.append((doc[g] * width + xs[:, None] * width_b + ys[None, :]).ravel())
            counts.append((x_times[:, None] * y_times[None, :]).ravel())
        keys, inverse = np.unique(np.concatenate(many), return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        times = total
    return keys // width, keys % width, times


def spelled(raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """For each text, whether its tokens' bytes are the text's bytes."""
    owner = np.repeat(np.arange(len(sizes)), counts)
    right = np.bincount(owner, weights=pieces.lengths[ids], minlength=len(sizes)).astype(np.int64) == sizes
    if right.all():
        at = np.repeat(np.arange(len(sizes)), sizes)
        right[at[raw != pieces.spell(ids)]] = False
    else:
        mine, here = np.repeat(right, sizes), np.repeat(right, counts)
        at = np.repeat(np.arange(len(sizes)), sizes)[mine]
        right[at[raw[mine] != pieces.spell(ids[here])]] = False
    return right


def align(texts: list[str], encoder, pieces_a: Pieces, model, pieces_b: Pieces, words: list[bytes]):
    """Counts, digest and linked id pairs of each text (see ``align_tokens``)."""
    n, width_b = len(texts), len(pieces_b.lengths)
    width = len(pieces_a.lengths) * width_b
    full = [k for k, t in enumerate(texts) if t]
    spaced = [" " + texts[k] for k in full]
    lists_a = [encoder.encode_to_numpy(t, disallowed_special=()) for t in spaced]
    lists_b = [np.array(x, dtype=np.int64) for x in model.encode([texts[k] for k in full], num_threads=1)] if full else []
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    ids_a, ids_b = join(lists_a), join(lists_b)
    count_a, count_b = (np.array([len(x) for x in lists], dtype=np.int64) for lists in (lists_a, lists_b))
    coded = [t.encode() for t in spaced]
    sizes = np.array([len(t) for t in coded], dtype=np.int64)
    raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
    right = spelled(raw, sizes, ids_a, count_a, pieces_a) & spelled(raw, sizes, ids_b, count_b, pieces_b)
    ids_a, ids_b = ids_a[np.repeat(right, count_a)], ids_b[np.repeat(right, count_b)]
    sizes, count_a, count_b = sizes[right], count_a[right], count_b[right]
    which = np.array(full, dtype=np.int64)[right]

    out = {name: np.zeros(n, dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [""] * n
    if not len(which):
        return out, digests, np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cuts, upto_a, upto_b = shared_cuts(np.cumsum(pieces_a.lengths[ids_a]), np.cumsum(pieces_b.lengths[ids_b]), int(sizes.sum()))
    first_a, first_b = np.append(0, upto_a[:-1]), np.append(0, upto_b[:-1])
    na, nb = upto_a - first_a, upto_b - first_b
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, cuts, side="left")
    out["n_a"][which], out["n_b"][which] = count_a, count_b
    out["n_groups"][which] = np.bincount(doc, minlength=len(which))
    links = np.zeros(len(which), dtype=np.int64)
    np.add.at(links, doc, na * nb)
    out["n_links"][which] = links

    # In the digest's order a group's A ids come before its B ids; ``words`` holds each id with ",", "|", ";" and alone.
    span = len(words) // 4
    order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    last_a[upto_a - 1], last_b[upto_b - 1] = 1, 2
    last_b[np.cumsum(count_b) - 1] = 3
    order[np.arange(len(ids_a)) + np.repeat(first_b, na)] = ids_a + span * last_a
    order[np.arange(len(ids_b)) + np.repeat(upto_a, nb)] = ids_b + span * last_b
    stop = np.cumsum(count_a + count_b)
    for k, begin, end in zip(which.tolist(), (stop - count_a - count_b).tolist(), stop.tolist(), strict=True):
        digests[k] = hashlib.sha256(b"".join([words[w] for w in order[begin:end].tolist()])).hexdigest()

    owner, pairs, times = linked_pairs(ids_a, ids_b, na, nb, first_a, first_b, doc, width_b, width)
    held = np.zeros(n, dtype=np.int64)
    held[which] = np.bincount(owner, minlength=len(which))
    return out, digests, np.append(0, np.cumsum(held)), pairs, times


def align_tokens(docs: DataFrame, byte_level: bytes, pieces: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of two vocabularies line up in each text, and how usual their links are.

    ``byte_level`` (A) is the content of a byte-level vocabulary file, ``pieces``
    (B) that of a piece model. A encodes a space and the text; B adds the space
    itself. Special tokens are plain text.

    Returns one row for each row: the id column, n_a, n_b, n_groups, n_links,
    n_best (links whose id pair is in as many rows as the most frequent pair of its A
    id), count_sum (over links, rows that hold the id pair linked) and groups_sha256.

    A null or empty text, or one whose tokens don't spell it, has no tokens: zeros
    and an empty digest. Repeated rows count as rows each. No rows give no rows.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((byte_level, pieces))  # two vocabulary files: a fixed size
    width_b = len(load_pieces(pieces)[1].lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces_a = load_byte_level(files.value[0])
        model, pieces_b = load_pieces(files.value[1])
        span = max(len(pieces_a.lengths), len(pieces_b.lengths))
        words = [b"%d%s" % (k, end) for end in (b",", b"|", b";", b"") for k in range(span)]
        for batch in batches:
            size, begin = 0, 0
            column = batch.column(1)
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for k in range(batch.num_rows):
                size += lengths[k]
                if k + 1 < batch.num_rows and size + lengths[k + 1] <= CHUNK:
                    continue
                texts = [t or "" for t in column.slice(begin, k + 1 - begin).to_pylist()]
                out, digests, offsets, pairs, times = align(texts, encoder, pieces_a, model, pieces_b, words)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int64())) for v in (pairs, times)]
                arrays = [batch.column(0).slice(begin, len(texts)), *(pa.array(v) for v in out.values()), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *out, "groups_sha256", "pairs", "times"])
                size, begin = 0, k + 1

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    aligned = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "aligned")

    counted = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "id-pairs")
    first = F.floor(F.col("pair") / F.lit(width_b)).cast("long")
    most = counted.groupBy(first.alias("first")).agg(F.max("n").alias("most"))  # a row for each id of A at most
    counted = counted.join(F.broadcast(most), first == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    frequent = materialize(counted.orderBy(F.desc("n"), "pair").limit(FREQUENT), "frequent-pairs")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))

    def weighed(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    near = weighed(links.join(F.broadcast(frequent), "pair"))
    known = F.broadcast(frequent.select("pair"))
    far = weighed(links.join(known, "pair", "left_anti").join(counted.join(known, "pair", "left_anti"), "pair"))
    sums = near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (
        aligned.drop("pairs", "times")
        .join(sums, "row", "left")
        .select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    )
