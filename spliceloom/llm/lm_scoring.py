"""Language-model scores by deleted interpolation.

Method. Bigram, unigram and uniform estimates are mixed. The weights depend on
how often the context was seen (buckets by powers of two) and are learned by
expectation-maximisation on counts from which the token itself is deleted, so
every training token serves as held-out data once.

Plan. Texts are packed into blocks, one row each. A block sends its distinct words
(128-bit cryptographic digests) and bigrams (64-bit hashes of their words'
digests) with their training counts, sorted and packed, to buckets by leading
bits; a bucket adds up the counts of all blocks and answers each block with the
totals alone, in the order in which the block asked. So hot words are summed
before any shuffle, and no vocabulary is ever gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_texts, bucket_bits, cuts, distinct_pairs, pack_blocks, planes, unplanes
from .common import fold, materialize
from .shingles import mix, plain_words

LEVELS = 48
STEP = 8.0  # cells per factor of two in the statistics of EM
#: What stands for a text's end, as a token, and for its begin, as a context, among the digests.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
WORDS, PAIRS = 0, 1
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def local_words(texts: bytes) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """A block's distinct words by first appearance, each token's place among them (-1 for an end), and tokens per text."""
    place: dict[bytes, int] = {}
    tokens: list[int] = []
    lengths: list[int] = []
    for text in block_texts(texts):
        words = plain_words(text.as_py())
        tokens.extend([place.setdefault(w, len(place)) for w in words])
        tokens.append(-1)
        lengths.append(len(words) + 1)
    return place, np.array(tokens, dtype=np.int64), np.array(lengths, dtype=np.int64)


class Block:
    """Tokens of a block's texts: distinct words and bigrams in order, and each token's place among them."""

    def __init__(self, flags: list[bool], texts: bytes, bits: int) -> None:
        place, tokens, self.lengths = local_words(texts)
        self.train = np.repeat(np.array(flags, dtype=bool), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        found = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in place)
        n_words = len(place)
        del place
        digests = np.frombuffer(found, dtype="<u8").reshape(-1, 2).astype(np.uint64)
        second = np.append(digests[:, 0], END)[tokens]
        first = np.roll(second, 1)
        first[self.starts] = BEGIN
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        moved = np.full(n_words + 1, n_words, dtype=np.int32)  # an end comes after all words
        moved[order] = np.arange(n_words, dtype=np.int32)
        pairs, pair = np.unique(mix(first * _A + mix(second ^ _B)), return_inverse=True)
        self.grams = [digests[order, 0], pairs]
        self.more = digests[order, 1]
        self.places = [moved[tokens], pair.astype(np.int32)]
        self.cuts = [cuts(g, bits) for g in self.grams]

    def training_counts(self, kind: int) -> np.ndarray:
        return np.bincount(self.places[kind][self.train], minlength=len(self.grams[kind])).astype(np.uint32)

    def totals(self, kind: int, answers: pa.Table) -> np.ndarray:
        """Totals of the block's words or bigrams, from the buckets' answers."""
        sizes = np.diff(self.cuts[kind])
        mine = answers.filter(pc.equal(answers["kind"], kind)).sort_by("bucket")
        parts = [unplanes(t.as_py(), f"<u{len(t.as_py()) // int(sizes[b.as_py()])}") for b, t in zip(mine["bucket"], mine["totals"])]
        out = np.concatenate([np.zeros(0), *parts])
        assert len(out) == len(self.grams[kind])
        return out


def send_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, block, keys, more, counts) of every block; ``more`` is the second half of words' digests."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, flags, texts in zip(*batch.columns):
                b = Block(flags.as_py(), texts.as_py(), bits)
                for kind in (WORDS, PAIRS):
                    keys, counts, at = b.grams[kind], b.training_counts(kind), b.cuts[kind]
                    full = np.flatnonzero(np.diff(at)).tolist()
                    spans = [slice(at[k], at[k + 1]) for k in full]
                    columns = [
                        pa.array([kind] * len(full), pa.int32()),
                        pa.array(full, pa.int32()),
                        pa.array([block.as_py()] * len(full), pa.int64()),
                        pa.array([planes(np.diff(keys[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
                        pa.array([planes(b.more[s]) if kind == WORDS else b"" for s in spans], pa.binary()),
                        pa.array([planes(counts[s]) for s in spans], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "block", "keys", "more", "counts"])

    schema = "kind int, bucket int, block long, keys binary, more binary, counts binary"
    return blocks.select("block", "flags", "texts").mapInArrow(send, schema)


def answer_counts(sent: DataFrame) -> DataFrame:
    """Totals of a bucket, returned to each block in its own order; its row without block has their sum and how many are not 0."""

    def answer(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        asked = [np.cumsum(unplanes(x.as_py(), "<u8"), dtype=np.uint64) for x in table["keys"]]
        keys = np.concatenate(asked)
        if kind == WORDS:
            place = distinct_pairs(keys, np.concatenate([unplanes(x.as_py(), "<u8") for x in table["more"]]))[2]
        else:
            place = np.unique(keys, return_inverse=True)[1]
        del keys
        totals = np.bincount(place, weights=np.concatenate([unplanes(x.as_py(), "<u4") for x in table["counts"]]))
        answers = np.split(totals[place], np.cumsum([len(x) for x in asked])[:-1])
        packed = [planes(x.astype(np.uint8 if x.max() < 256 else np.uint32 if x.max() < 1 << 32 else np.uint64)) for x in answers]
        n = len(packed)
        return pa.table(
            {
                "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
                "kind": pa.array([kind] * (n + 1), pa.int32()),
                "bucket": pa.array([table["bucket"][0].as_py()] * (n + 1), pa.int32()),
                "totals": pa.array([*packed, None], pa.binary()),
                "tokens": pa.array([*[0] * n, int(totals.sum())], pa.int64()),
                "types": pa.array([*[0] * n, int(np.count_nonzero(totals))], pa.int64()),
            }
        )

    return sent.groupBy("kind", "bucket").applyInArrow(answer, "block long, kind int, bucket int, totals binary, tokens long, types long")


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.minimum(LEVELS - 1, np.floor(np.log2(context + 1))).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def learn_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 200) -> np.ndarray:
    """EM over (level, pair cell, word cell, tokens): weights of bigram, unigram and uniform by level."""
    weights = np.tile([0.4, 0.4, 0.2], (LEVELS, 1))
    by_level: dict[int, list] = {}
    for lv, p2, p1, n in cells:
        by_level.setdefault(lv, []).append((2.0 ** (p2 / STEP) if p2 < 1 else 0.0, 2.0 ** (p1 / STEP) if p1 < 1 else 0.0, n))
    for lv, rows in by_level.items():
        a = np.array([[p2, p1, uniform] for p2, p1, _ in rows])
        n = np.array([x[2] for x in rows], dtype=np.float64)
        w = weights[lv]
        for _ in range(rounds):
            share = a * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
            w = np.maximum(w, 1e-7)
            w /= w.sum()
        weights[lv] = w
    for lv in range(LEVELS):  # levels without tokens take the weights of the next lower one
        if lv not in by_level and lv:
            weights[lv] = weights[lv - 1]
    return weights


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 10,
    block_bytes: int = 12_000_000,
    bits: int = 9,
) -> DataFrame:
    """Log10 probability of every whole text, learned from the ids outside fold 0.

    Words are runs of characters other than white space, A-Z lower-cased, and an
    end follows each text. Returns one row per input row: the id column,
    held_out, n_tokens, n_known, train_tokens, base_score (unigrams with 0.1 added
    to each count) and score. ``2**bits`` buckets share the counts, or as
    many as there are blocks, so that a bucket's fit a task at any size.

    Null or empty texts are the end alone. A null id is not held out. Repeated
    rows count and are scored as often as they occur. No rows give no rows;
    without training texts all tokens are unknown. Other columns are not read,
    whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), (fold(F.col(id_col), folds) != 0).alias("flag"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    blocks = materialize(pack_blocks(rows, block_bytes), "lm-blocks")
    bits = bucket_bits(blocks, bits)
    n_docs = blocks.select(F.sum(F.size(F.filter("flags", lambda t: t)))).first()[0] or 0
    answers = materialize(answer_counts(send_counts(blocks, bits)), "lm-totals")
    sums = answers.where((F.col("kind") == WORDS) & F.col("block").isNull())
    n_words, n_types = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n_train, n_types = n_words + n_docs, n_types + (n_docs > 0)
    uniform = 1 / (n_types + 1)
    mine = answers.where(F.col("block").isNotNull()).select("block", "kind", "bucket", "totals")
    both = blocks.groupBy("block").cogroup(mine.groupBy("block"))

    def counted(left: pa.Table, right: pa.Table) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
        """The block, and the totals of each token's word, context and bigram."""
        block = Block(left["flags"][0].as_py(), left["texts"][0].as_py(), bits)
        word = np.append(block.totals(WORDS, right), n_docs)[block.places[WORDS]]
        context = np.roll(word, 1)
        context[block.starts] = n_docs
        return block, word, context, block.totals(PAIRS, right)[block.places[PAIRS]]

    def statistics(left: pa.Table, right: pa.Table) -> pa.Table:
        block, word, context, pair = counted(left, right)
        t = block.train
        context = context[t] - 1
        cell = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEP), 1).astype(np.int64)
        p2, p1 = cell(_ratio(pair[t] - 1, context)), cell((word[t] - 1) / max(1, n_train - 1))
        code = (level(context) * 1024 + (p2 + 512)) * 1024 + (p1 + 512)
        codes, n = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

    # Cells of an eighth of a power of two: their number is bounded, however large the input.
    found = both.applyInArrow(statistics, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([(r.code >> 20, (r.code >> 10 & 1023) - 512, (r.code & 1023) - 512, r.n) for r in found], uniform)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, word, context, pair = counted(left, right)
        w = weights[level(context)]
        p = w[:, 0] * _ratio(pair, context) + w[:, 1] * (word / max(1, n_train)) + w[:, 2] * uniform
        base = np.log10((word + 0.1) / (n_train + 0.1 * (n_types + 1)))
        n, starts = len(block.starts), block.starts
        return pa.table(
            {
                "id": left["ids"].combine_chunks().flatten(),
                "held_out": pa.array(~np.array(left["flags"][0].as_py(), dtype=bool)),
                "n_tokens": pa.array(block.lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), starts), pa.int64()),
                "train_tokens": pa.array(np.full(n, n_train, dtype=np.int64)),
                "base_score": pa.array(np.add.reduceat(base, starts)),
                "score": pa.array(np.add.reduceat(np.log10(p), starts)),
            }
        )

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.applyInArrow(score, schema).withColumnRenamed("id", id_col)
