"""Token counts against encoding and decoding token by token."""

import random
from pathlib import Path

import numpy as np
import pytest

from spliceloom.llm.queries import RANKS
from spliceloom.llm.token_counts import attribute, count_tokens, load_encoder, token_spans

pytestmark = pytest.mark.skipif(not Path(RANKS).exists(), reason="needs the public vocabulary file")


def test_spans_round_trip():
    data = Path(RANKS).read_bytes()
    encoder, lengths = load_encoder(data)
    for text in ("plain words here", "naïve façade 漢字かな 🙂🙂 end", "a\n\n\nb  c"):
        ids = encoder.encode_ordinary(text)
        assert encoder.decode(ids) == text
        starts, ends = token_spans(text, ids, lengths)
        at = np.cumsum([0, *(lengths[ids])])
        for k, (s, e) in enumerate(zip(starts, ends)):
            part = encoder.decode_single_token_bytes(ids[k]).decode(errors="ignore")
            assert part in text[s:e]
        assert ends[-1] == len(text) and at[-1] == len(text.encode())


def test_crossing_tokens_go_to_the_larger_part():
    starts, ends = np.array([0, 3, 8]), np.array([3, 8, 10])
    tokens, crossing = attribute(starts, ends, np.array([0, 5]), 10)
    assert tokens.tolist() == [1, 2] and crossing.tolist() == [0, 1]
    tokens, crossing = attribute(np.array([0]), np.array([4]), np.array([0, 2]), 4)
    assert tokens.tolist() == [1, 0]
    # One token over three sections of equal size, and over three of which the last is larger.
    tokens, crossing = attribute(np.array([0]), np.array([6]), np.array([0, 2, 4]), 6)
    assert tokens.tolist() == [1, 0, 0] and crossing.tolist() == [1, 0, 0]
    tokens, _ = attribute(np.array([0]), np.array([5]), np.array([0, 1, 2]), 5)
    assert tokens.tolist() == [0, 0, 1]


def plain_sections(texts, encoder):
    """(first character, end, tokens, crossing tokens) of each section, one token and character after another."""
    text = "\n".join(texts)
    starts = {0}
    at = 0
    for t in texts[:-1]:
        at += len(t) + 1
        if at < len(text):
            starts.add(at)
    for k in range(1, len(text)):
        if text[k - 1] == "\n" and text[k] != "\n":
            starts.add(k)
    starts = sorted(starts)
    section = [max(s for s in starts if s <= k) for k in range(len(text))]
    of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    counts, crossing, at = dict.fromkeys(starts, 0), dict.fromkeys(starts, 0), 0
    for token in encoder.encode_ordinary(text):
        n = len(encoder.decode_single_token_bytes(token))
        held = [section[k] for k in sorted(set(of_byte[at : at + n]))]
        owner = max(sorted(set(held)), key=held.count)
        counts[owner] += 1
        crossing[owner] += len(set(held)) > 1
        at += n
    return [(s, e, counts[s], crossing[s]) for s, e in zip(starts, [*starts[1:], len(text)])]


def test_sections_against_brute_force(spark):
    data = Path(RANKS).read_bytes()
    encoder, _ = load_encoder(data)
    rng = random.Random(4)
    pieces = ["word", " and", "\n", "\n\n", " ", "   ", "\t", "é", "漢字", "🙂", "1234", "!!", "\n \n", "x" * 30]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for k in range(150)]
    rows.append((900, "a line of words\n" * 3000, "end"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, field string")
    got = {}
    for r in count_tokens(frame, data, fields=("text", "field")).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.n_tokens, r.n_crossing))
    for i, *texts in rows[:-1]:
        assert got[i] == plain_sections(texts, encoder), texts
    long = "\n".join(rows[-1][1:])
    assert sum(n for _, _, n, _ in got[900]) == len(encoder.encode_ordinary(long)) and len(got[900]) == 3001
    assert sum(c for sections in got.values() for *_, c in sections) > 20


def test_counts_by_section(spark):
    data = Path(RANKS).read_bytes()
    encoder, _ = load_encoder(data)
    rows = [(1, "first line\nsecond line\n\nthird", "t"), (2, None, None), (3, "", "only a title"), (None, "x", "y"), (1, "first line\nsecond line\n\nthird", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, section string")
    got = count_tokens(frame, data, fields=("text", "section")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert sum(r.n_tokens for r in by[1]) == 2 * len(encoder.encode_ordinary("first line\nsecond line\n\nthird\nt"))
    assert [r.n_tokens for r in by[2]] == [1] and len(by[3]) == 2 and len(by[None]) == 2
    assert count_tokens(frame.limit(0), data).count() == 0
    one = count_tokens(frame.where("doc_id = 2"), data).collect()
    assert [(r.section, r.n_tokens, r.doc_tokens) for r in one] == [(0, 0, 0)]
