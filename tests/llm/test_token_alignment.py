"""Token alignment against sets of offsets and both libraries' own encodings."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from spliceloom.llm import token_alignment
from spliceloom.llm.queries import BYTE_LEVEL, PIECES
from spliceloom.llm.token_alignment import align_tokens, byte_letters, linked_pairs, load_byte_level, shared_cuts

pytestmark = pytest.mark.skipif(not Path(BYTE_LEVEL).exists(), reason="needs the public vocabulary files")
SCHEMA = "doc_id long, text string, id string, row string, pair string, pairs string, n long, best int"


def brute(rows):
    """Every row by itself, with the tokenizers' own library instead of ranks."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    letters, names = byte_letters(), {v: k for k, v in first.get_vocab().items()}
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    piece = lambda k: bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()
    found, holders = [], Counter()
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a, bytes_b = [bytes(letters[c] for c in names[k]) for k in a], [piece(k) for k in b]
        if text and not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
            a, b, bytes_a, bytes_b = [], [], [], []
        ends = [set(np.cumsum([len(t) for t in tokens]).tolist()) for tokens in (bytes_a, bytes_b)]
        groups = defaultdict(lambda: ([], []))
        cuts = sorted(ends[0] & ends[1])
        for side, (ids, tokens) in enumerate(((a, bytes_a), (b, bytes_b))):
            at = 0
            for k, t in zip(ids, tokens, strict=True):
                at += len(t)
                groups[cuts[bisect_left(cuts, at)]][side].append(k)
        parts = [groups[c] for c in cuts]
        links = Counter((x, y) for xs, ys in parts for x in xs for y in ys)
        holders.update(links.keys())
        digest = hashlib.sha256(";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in parts).encode()).hexdigest() if a else ""
        found.append((doc, len(a), len(b), len(parts), links, digest))
    most = Counter()
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return sorted(
        ((doc, n_a, n_b, n, links.total(), sum(t for (x, y), t in links.items() if holders[x, y] == most[x]), sum(t * holders[p] for p, t in links.items()), digest) for doc, n_a, n_b, n, links, digest in found),
        key=repr,
    )


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", 1, 2) for r in rows], SCHEMA)
    found = align_tokens(frame, Path(BYTE_LEVEL).read_bytes(), Path(PIECES).read_bytes())
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)


def make_rows(seed=4):
    rng = random.Random(seed)
    words = ["the", "Überraschung", "naïve", "漢字", "🙂", "x", "    ", "\n\n", "\t", "2024", "don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "it's", "antidisestablishment", "\r\n", " ", "é", "é"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, " "), (63, "\n"), (64, "a▁b"), (65, "\x00 nul"), (66, "a" * 3000), (67, "漢" * 500), (None, "no id here"), (68, "word " * 2000)]
    return [*rows, rows[5], rows[5]]


def test_against_offsets(spark, monkeypatch):
    rows = make_rows()
    expected = brute(rows)
    assert any(r[1] == 0 for r in expected)
    assert run(spark, rows) == expected
    monkeypatch.setattr(token_alignment, "FREQUENT", 3)  # nearly all counts by the join
    assert run(spark, rows) == expected


def test_no_rows(spark):
    assert run(spark, []) == []


def test_same_ids_as_the_library():
    from tokenizers import Tokenizer

    own, _ = load_byte_level(Path(BYTE_LEVEL).read_bytes())
    other = Tokenizer.from_file(BYTE_LEVEL)
    other.encode_special_tokens = True
    for text in (" a  b\n\n c \t\n", " don't we'll I'm it'S", " 12 345,6", " 　x y", " <|endoftext|> <|endoftext|>", "  trailing   ", " ñandú 漢字 🙂🙂"):
        assert list(own.encode_ordinary(text)) == other.encode(text, add_special_tokens=False).ids, text


def test_ranks_of_cuts():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(rng.integers(1, size + 1, size // 2), size)) for _ in range(2))
        cuts, upto_a, upto_b = shared_cuts(a, b, size)
        assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert upto_a.tolist() == [int((a <= c).sum()) for c in cuts] and upto_b.tolist() == [int((b <= c).sum()) for c in cuts]


def test_wide_groups_are_counted_like_others(monkeypatch):
    rng = np.random.default_rng(1)
    na, nb = np.array([3, 40, 2, 25]), np.array([2, 30, 5, 1])
    a, b = rng.integers(0, 9, na.sum()), rng.integers(0, 7, nb.sum())
    given = (a, b, na, nb, np.cumsum(na) - na, np.cumsum(nb) - nb, np.array([0, 0, 1, 1]), 7, 63)
    plain = linked_pairs(*given)
    monkeypatch.setattr(token_alignment, "WIDE", 20)
    for x, y in zip(plain, linked_pairs(*given), strict=True):
        assert x.tolist() == y.tolist()


def test_very_long_text():
    data = Path(BYTE_LEVEL).read_bytes()
    own, pieces = load_byte_level(data)
    for text in (" " * 300_000, "word " * 300_000, "ab\n" * 200_000):
        assert pieces.lengths[own.encode_to_numpy(text, disallowed_special=())].sum() == len(text)
