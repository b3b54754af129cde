"""Each operator against a brute-force version on small awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spliceloom.llm.blocks import distinct_pairs
from spliceloom.llm.embedding_dedup import collision_rule, directions, embedding_dedup, passing, unit
from spliceloom.llm.exact_dedup import exact_dedup, split_directory
from spliceloom.llm.graph import components
from spliceloom.llm.lm_scoring import score_texts
from spliceloom.llm.mixing import mix_sources, schedule
from spliceloom.llm.ngram_join import Rule, jaccard_join, plan_level, segment_keys
from spliceloom.llm.packing import best_fit, pack
from spliceloom.llm.secrets import scan_secrets, scan_text
from spliceloom.llm.shingles import exact_sets, word_hashes
from spliceloom.llm.suffix_dedup import suffix_dedup
from spliceloom.llm.suffixes import suffix_array
from spliceloom.llm.toxicity import fit_logistic, maximal_segments, score_toxicity, solve_lambda

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns with names that operators use inside.
SCHEMA = "doc_id long, text string, source string, id string, size int, n long, class string, key binary, block int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make_docs(seed=3):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"] + [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(80))
    texts = [None, "", " \t\n", "one", "one", "two words", "Two  words", passage, passage, passage.replace(" ", "\n", 3)]
    for k in range(40):
        body = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120)))
        texts.append(body if k % 3 else body + " " + passage + " " + rng.choice(vocab))
    base = [rng.choice(vocab) + str(k) for k in range(90)]
    for k in range(8):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    texts.append("a" * 1500)
    texts.append("long " * 4000)
    rows = [(k, t, [None, "s", "a", "b", "Z"][k % 5]) for k, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, s, "x", 1, 2, "c", b"k", 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none, rows):
    squeezed = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows]
    groups = {}
    for (i, t, _), s in zip(rows, squeezed):
        groups.setdefault(s, []).append((-len(t or ""), i))
    got = exact_dedup(docs, capacity=4).collect()
    assert len(got) == len(rows)
    text = {i: s for (i, _, _), s in zip(rows, squeezed)}
    for r in got:
        group = groups[text[r.doc_id]]
        assert r.group_size == len(group) and r.keep_id == min(group)[1]
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize("spread", [False, True])
def test_directory_splits_until_buckets_fit(spark, spread):
    # Keys that agree in their leading 20 bits need a directory deeper than one count of bits.
    key = F.xxhash64("id") if spread else F.shiftrightunsigned(F.xxhash64("id"), 20)
    keys = spark.range(400).select(key.alias("key"))
    found, depth = split_directory(keys, 20 if spread else 50)
    slots = {r.slot: (r.depth, r.bucket) for r in found.collect()}
    assert len(slots) == found.count() and max(d for d, _ in slots.values()) == depth
    held = Counter()
    for r in keys.collect():
        bits = r.key & (2**64 - 1)
        d, bucket = slots[bits >> (64 - depth)]
        assert bits >> (64 - d) == bucket
        held[d, bucket] += 1
    assert max(held.values()) <= (20 if spread else 50) and sum(held.values()) == 400
    # A bucket is split only if it was overfull.
    for d, bucket in held:
        if d:
            assert sum(n for (e, b), n in held.items() if e >= d - 1 and b >> (e - d + 1) == bucket >> 1) > (20 if spread else 50)


def test_exact_dedup_goes_through_the_directory(docs, monkeypatch):
    """Without some of its slots, rows that they lead to are not found; a chain holds what shares a key."""
    whole = {r.doc_id: (r.bucket_depth, r.bucket) for r in exact_dedup(docs, capacity=4).collect()}
    assert len(set(whole.values())) > 5

    def half(keys, capacity):
        directory, depth = split_directory(keys, capacity)
        return directory.where("bucket % 2 = 0"), depth

    monkeypatch.setattr("spliceloom.llm.exact_dedup.split_directory", half)
    assert {r.doc_id for r in exact_dedup(docs, capacity=4).collect()} == {i for i, (_, b) in whole.items() if b % 2 == 0}


def test_exact_dedup_chains_texts_of_one_key(docs, rows, monkeypatch):
    """With one key for all texts, links of its chain tell them apart; with one hash for all, the texts do."""
    want = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(docs).collect())
    monkeypatch.setattr("spliceloom.llm.exact_dedup.F.xxhash64", lambda *c: F.lit(7).cast("long"))
    chained = exact_dedup(docs, capacity=4).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in chained) == want
    assert len({r.chain_link for r in chained}) > 40
    monkeypatch.setattr("spliceloom.llm.exact_dedup.F.sha2", lambda c, n: F.lit("00"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(docs).collect()) == want


def test_mixing(docs, none, rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    got = mix_sources(docs, block=16).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    # What the schedule's discrepancy takes from a source is a few blocks; none gets more than its target.
    for s in names:
        assert target[s] - 4 * 16 <= taken[s] <= target[s] + 1
    again = {(r.doc_id, r.taken) for r in mix_sources(docs.repartition(2), block=16).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mix_sources(none).count() == 0


def test_schedule_decides_what_is_taken(spark, docs, monkeypatch):
    weights = [(0, 0, 1 << 31), (1, 1 << 31, 3 << 30), (2, 3 << 30, 1 << 32)]
    plan = spark.createDataFrame([(k, lo, hi, (hi - lo) * 1000 >> 32) for k, lo, hi in weights], "sid long, lo long, hi long, slots long")
    got = sorted((r.slot, r.sid, r["rank"]) for r in schedule(spark, plan, chunk=64).collect())
    assert [r[0] for r in got] == list(range(1000))
    seen = Counter()
    for slot, sid, rank in got:
        assert rank == seen[sid]
        seen[sid] += 1
        assert all(abs(seen[k] - (slot + 1) * (hi - lo) / (1 << 32)) < 3 for k, lo, hi in weights)
    whole = {(r.doc_id, r.taken) for r in mix_sources(docs, block=16).collect()}
    first = lambda spark, plan: schedule(spark, plan).where("slot < 20")
    monkeypatch.setattr("spliceloom.llm.mixing.schedule", first)
    cut = mix_sources(docs, block=16).collect()
    assert sum(r.taken for r in cut) <= 20 * 16 < sum(t for _, t in whole)


def test_packing(docs, none, rows):
    got = pack(docs, capacity=64, per_source=2, shard_rows=20).collect()
    total = Counter()
    by_bin = {}
    for r in got:
        total[r.doc_id] += r["size"]
        by_bin.setdefault(r.bin, []).append(r)
    for i, t, _ in rows:
        assert total[i] == len(WORD.findall(t or "")) * (2 if i == 7 else 1)
    for group in by_bin.values():
        assert sum(r["size"] for r in group) == group[0].bin_fill <= 64
        clusters = [r.cluster for r in group if r.cluster is not None]
        assert len(clusters) == len(set(clusters))
        assert max(Counter(r.source for r in group).values()) <= 2
    assert pack(none).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    assert best_fit([60, 50, 40, 10], [0, 1, 2, 3], [-1, -1, -1, -1], 100, 1) == [0, 1, 0, 1]
    assert best_fit([60, 50, 40], [0, 1, 0], [-1, -1, -1], 100, 1) == [0, 1, 1]
    assert best_fit([60, 50, 40], [0, 1, 2], [5, 6, 5], 100, 1) == [0, 1, 1]


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        n, capacity, most = rng.randint(1, 40), rng.choice([10, 30]), rng.randint(1, 3)
        sizes = [rng.randint(0, capacity) for _ in range(n)]
        sources, clusters = [rng.randrange(4) for _ in range(n)], [rng.randint(-1, 5) for _ in range(n)]
        bins = []
        want = [0] * n
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            fits = []
            for b, held in enumerate(bins):
                room = capacity - sum(sizes[j] for j in held)
                crowded = sum(sources[j] == sources[i] for j in held) >= most
                twin = clusters[i] >= 0 and any(clusters[j] == clusters[i] for j in held)
                if room >= sizes[i] and not crowded and not twin:
                    fits.append((room, b))
            if not fits:
                fits = [(capacity, len(bins))]
                bins.append([])
            want[i] = min(fits)[1]
            bins[want[i]].append(i)
        assert best_fit(sizes, sources, clusters, capacity, most) == want


def test_packing_of_rows_without_source_or_id(spark):
    rows = [(None, "a b c", None, 1), (None, "a b c", None, 2), (3, "d e", None, 3), (3, "f " * 25, "s", 4), (4, None, "s", 5), (5, "", None, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = pack(frame, capacity=10, per_source=2).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter({(None, 3): 2, (3, 2): 1, (3, 10): 2, (3, 5): 1, (4, 0): 1, (5, 0): 1})
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin, []).append(r)
    for held in by_bin.values():
        assert sum(r["size"] for r in held) == held[0].bin_fill <= 10 and max(Counter(r.source for r in held).values()) <= 2
        assert len({r.cluster for r in held if r.cluster}) == sum(r.cluster is not None for r in held)


def test_secrets(docs, none, rows):
    text = (
        'x = "Zk83hQpL20vvT"\npassword = x\nAPI_KEY: abcdefghijkl0\n"client_secret" => "qW9!xY7#zz" + "mN4@"\n'
        "secret: token: abcdefghijklmnop\nAKIAABCDEFGHIJKLMN deadbeefdeadbeef00 note: ok"
    )
    base, spans = scan_text(text)
    assert [text[s:e] for s, k, e in base if k == 0] == ["API_KEY: abcdefghijkl0"]
    assert [text[s:e] for s, k, e in base if k == 1] == ["AKIAABCDEFGHIJKLMN"]
    assert [text[s:e] for s, k, e in base if k == 2] == ["deadbeefdeadbeef00"]
    assert {text[s:e] for s, k, e in spans if k == 3} == {"Zk83hQpL20vvT", "qW9!xY7#zz", "mN4@"}
    assert set(base) <= set(spans)
    assert scan_text("the token of the day: password protected, pwd = changeme-please")[1] == []
    got = scan_secrets(docs).collect()
    assert len(got) == len(rows) and {r.spans for r in got} == {"", "hex:0:1500"}
    assert scan_secrets(none).count() == 0


@pytest.mark.parametrize(
    "line, secret",
    [
        ("api.key=Zk83hQpL20vvT9", "Zk83hQpL20vvT9"),
        ("api__key = Zk83hQpL20vvT9", "Zk83hQpL20vvT9"),
        ("pass_phrase: Zk83hQpL20vvT9", "Zk83hQpL20vvT9"),
        ('pass-word = "Zk83hQpL20vvT9"', "Zk83hQpL20vvT9"),
        ('pwd = "Tr0ub4dor$3xY"', "Tr0ub4dor$3xY"),
        ('pwd = "Zk8{hQ<pL*0>v}T"', "Zk8{hQ<pL*0>v}T"),
        ('pwd = "9aNullQ7trueZ"', "9aNullQ7trueZ"),
    ],
)
def test_secrets_do_not_hang_on_unrelated_text(line, secret):
    for text in (line, line + "\ntoken"):
        assert [text[s:e] for s, _, e in scan_text(text)[1]] == [secret]


@pytest.mark.parametrize("value", ["${DB_PASSWORD}", "<your-password>", "{{vault.password}}", "Ab1***********", "$DB_PASSWORD", "sk-xxxxxxxx-A1", "your_api_key", "{access_token}"])
def test_placeholders_are_no_secrets(value):
    assert scan_text(f'pwd = "{value}"')[1] == []


def test_secrets_of_many_pieces():
    def lexed(text):
        return [text[s:e] for s, k, e in scan_text(text)[1] if k == 3]

    pieces = [f"a{k:02d}Xy" for k in range(40)]
    assert lexed("password = " + " + ".join(f'"{p}"' for p in pieces)) == pieces
    assert lexed("\n".join(f'k{i} = "{p}"' for i, p in enumerate(pieces)) + "\npwd = " + " + ".join(f"k{i}" for i in range(40))) == pieces
    assert lexed('password = "" + "aB3" + "xY7" + "kQ" + "9"') == ["aB3", "xY7", "kQ", "9"]
    assert lexed('x = "aB3$"\npassword = x + x') == ["aB3$"]
    assert lexed('x = "aB3$"\n' + "x = x + x\n" * 300 + "password = x") == ["aB3$"]
    # Prose after the 16th piece is part of the value.
    assert lexed("password = " + " + ".join(f'"{p}"' for p in pieces[:16]) + ' + " is long"') == []


def test_constants_may_follow_their_use():
    def lexed(text):
        return [text[s:e] for s, k, e in scan_text(text)[1] if k == 3]

    assert lexed('password = k\nk = "Zk83hQpL20vvT"') == ["Zk83hQpL20vvT"]
    assert lexed('k = "Zk83hQpL20vvT"\npassword = k\nk = "Yk94hQpM31wwU"') == ["Zk83hQpL20vvT"]
    assert lexed('password = a + b\na = c\nb = "hQpL20vvT"\nc = "Zk83x"') == ["hQpL20vvT", "Zk83x"]
    assert lexed('password = a\na = b\nb = a + "Zk83hQpL20vvT"') == ["Zk83hQpL20vvT"]
    assert lexed("password = password") == lexed("password = a\na = b\nb = password") == []


def plain_scan(text):
    """The base patterns, matched step by step."""
    spans = []
    low = "".join(c.lower() if c.isascii() else c for c in text)
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    k = 0
    while k < len(text):
        name = next((w for w in names if low.startswith(w, k)), None)
        ends = []
        if name:
            for quote in (1, 0):
                j = k + len(name)
                if quote and text[j : j + 1] not in ('"', "'"):
                    continue
                j += quote
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                m = j
                while m < len(text) and text[m] in value:
                    m += 1
                if m > j:
                    ends.append((m, m - j))
                    break
        if ends:
            if ends[0][1] >= 12:
                spans.append((k, 0, ends[0][0]))
            k = ends[0][0]
        else:
            k += 1
    for kind, start, allowed, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        k = 0
        while k < len(text):
            m = k + len(start)
            if text.startswith(start, k):
                while m < len(text) and text[m] in allowed:
                    m += 1
            if text.startswith(start, k) and m > k + len(start):
                if m - k >= least:
                    spans.append((k, kind, m))
                k = m
            else:
                k += 1
    return sorted(spans)


def test_secret_scan_against_brute_force(spark):
    rng = random.Random(7)
    pieces = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH", "0123456789abcdef", "x9+/_.-", "\n", "é", "K", "ſecret", "deadbeef"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    rows = [(k, t, t) for k, t in enumerate(texts)] + [(1, texts[1], "y"), (9000, None, None), (None, 'token = "abcdefghijkl"', "x"), (9001, "x " * 200_000 + "secret=abcdefghijklm", "x")]
    found = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, t, _ in rows:
        base = plain_scan(t or "")
        r = by_id[i]
        assert r.base_spans == ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base), t
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert not r.base_spans or set(r.base_spans.split(",")) <= set(r.spans.split(","))
    assert sum(r.n_assign for r in found) > 100 and sum(r.n_hex for r in found) > 100


def test_maximal_segments():
    assert maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randint(-4, 4) for _ in range(rng.randint(1, 14))]

        def split(a, b):
            best = max(((sum(scores[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], best[3]
            return split(a, i) + [(i, j, best[0])] + split(j, b)

        assert sorted(s for *_, s in maximal_segments(scores)) == sorted(s for *_, s in split(0, len(scores)))


def test_toxicity(spark):
    rng = random.Random(5)
    vocab = [f"word{k}" for k in range(200)]
    docs, labels = [(900, None, "x"), (901, "", "x")], [(900, None), (5000, 1), (None, 1)]
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            at = rng.randrange(50)
            words[at : at + 6] = [rng.choice(["vilest", "foulmouth", "vilely"]) for _ in range(6)]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(frame, marks).collect()}
    assert len(got) == len(docs)
    for i in range(400):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(i % 4 == 0) == int(got[i].score >= 0.5)
    assert got[900].score == got[901].score < 0.5
    empty = frame.limit(0)
    assert score_toxicity(empty, marks).count() == 0
    assert score_toxicity(frame, marks.limit(0)).count() == len(docs)


def plain_toxicity(train, texts):
    """Scores of texts after learning from (text, toxic), over dictionaries."""
    tokens = lambda t: re.findall(r"\w+", t.lower())
    parts = lambda w: [w, *("^" + w[:n] for n in (5, 4) if len(w) >= n)]
    sides = {0: [tokens(t) for t, y in train if not y], 1: [tokens(t) for t, y in train if y]}
    counts = {y: Counter(u for ws in sides[y] for u in {u for w in ws for u in parts(w)}) for y in sides}
    clean, toxic = len(sides[0]), len(sides[1])
    known = {}
    for u in {*counts[0], *counts[1]}:
        n = counts[0][u] + counts[1][u]
        pseudo = max(10 * n / (clean + toxic), 0.5)
        a, b = counts[1][u] + pseudo, counts[0][u] + pseudo
        delta = math.log(a / (toxic + 11 - a)) - math.log(b / (clean + 11 - b))
        if n >= 4 and abs(delta / math.sqrt(1 / a + 1 / b)) >= 3:
            known[u] = max(-6, min(6, delta)) - 0.2
    score = lambda ws: [next((known[u] for u in parts(w) if u in known), -0.2) for w in ws]
    bins = Counter(round(s * 4) / 4 for ws in sides[0] for s in score(ws))
    lam = solve_lambda([(s, n / sum(bins.values())) for s, n in bins.items()])
    assert sum(n / sum(bins.values()) * math.exp(lam * s) for s, n in bins.items()) == pytest.approx(1, abs=1e-6)
    best = [max((s for *_, s in maximal_segments(score(ws))), default=0.0) for ws in sides[0]]
    mean = sum(round(4 * max(-25.0, lam * s - math.log(max(1, len(ws))))) / 4 for s, ws in zip(best, sides[0])) / len(best)
    k = math.exp(mean - 0.5772156649015329)

    def evidence(ws):
        base = math.log(k * max(1, len(ws)))
        return math.log1p(sum(max(0.0, lam * s - base) for *_, s in maximal_segments(score(ws))))

    points = {}
    for y in sides:
        for ws in sides[y]:
            points.setdefault(round(evidence(ws) * 32) / 32, [0, 0])[y] += 1
    a, b = fit_logistic([(x, c, t) for x, (c, t) in sorted(points.items())])
    return [1 / (1 + math.exp(-(a + b * evidence(tokens(t or ""))))) for t in texts]


def test_toxicity_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(80)] + ["vilest", "Vilely", "foul"]
    rows, labels = [(None, "vilest vilest", 1, "x"), (777, None, 1, "x"), (778, "vilest " * 30_000, 0, "y")], [(777, 1)]
    for i in range(300):
        bad = i % 3 == 0
        words = [rng.choice(vocab[80:] if bad and 5 <= k < 9 else vocab[:80] if rng.random() < 0.98 else vocab) for k in range(rng.randint(9, 40))]
        rows.append((i, " ".join(words), 1 - bad, "label"))
        labels.append((i, int(bad)))
    rows += [rows[5], (301, rows[6][1], 0, "z")]  # a repeated row, and a text under two ids
    labels.append((301, 1 - labels[4][1]))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, predicted string")
    got = score_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    marks = dict(labels)
    train = {}
    for i, t, *_ in rows:
        if i in marks and zlib.crc32(str(i).encode()) % 5:
            train[t or ""] = max(train.get(t or "", 0), marks[i])
    want = plain_toxicity(train.items(), [t for _, t, *_ in rows])
    assert Counter((r.doc_id, round(r.score, 7)) for r in got) == Counter((i, round(w, 7)) for (i, *_), w in zip(rows, want))
    assert all(r.predicted == int(r.score >= 0.5) for r in got) and len({r.score for r in got}) > 60


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        text = [rng.randint(0, rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(text, dtype=np.int64)) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("crowd", [512, 0])
def test_suffix_dedup(docs, none, rows, crowd):
    n = 200
    raw = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[k : k + n] for t in raw for k in range(len(t) - n + 1))
    want = {}
    for (i, _, _), t in zip(rows, raw):
        covered = [False] * len(t)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                covered[k : k + n] = [True] * n
        runs = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        kept = bytes(b for b, c in zip(t, covered) if not c)
        want[i] = (len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    got = suffix_dedup(docs, block_bytes=20_000, bits=2, crowd=crowd, shard_bytes=20_000).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert sum(w[1] for w in want.values()) > 0
    assert suffix_dedup(none).count() == 0


def plain_model(tokens):
    """Deleted interpolation over dictionaries: log10 probability of a text, from (held out, words and end) of all texts."""
    words, pairs = Counter(), Counter()
    for held, ws in tokens:
        if not held:
            words.update(ws)
            pairs.update(zip(["begin", *ws], ws))
    words["begin"] = words[None]
    n, uniform = sum(words.values()) - words["begin"], 1 / (len(words) - 1 + 1)
    bucket = lambda k: int(math.log2(k + 1))
    cells = {}
    for (a, b), k in pairs.items():
        left = words[a] - 1
        row = ((k - 1) / left if left else 0.0, (words[b] - 1) / (n - 1), uniform)
        cells.setdefault(bucket(left), Counter())[row] += k
    weights = {}
    for lv, rows in cells.items():
        w = (0.4, 0.4, 0.2)
        for _ in range(200):
            share = [0.0, 0.0, 0.0]
            for row, k in rows.items():
                total = sum(x * y for x, y in zip(w, row))
                for z in range(3):
                    share[z] += k * w[z] * row[z] / total
            w = [max(x / sum(share), 1e-7) for x in share]
        weights[lv] = w
    for lv in range(48):
        if lv not in weights:
            weights[lv] = weights.get(lv - 1, (0.4, 0.4, 0.2))

    def score(ws):
        out = 0.0
        for a, b in zip(["begin", *ws], ws):
            w = weights[bucket(words[a])]
            out += math.log10(w[0] * (pairs[a, b] / words[a] if words[a] else 0.0) + w[1] * words[b] / n + w[2] * uniform)
        return out

    return score


def test_lm_scoring(spark, docs, none, rows):
    tokens = [(i, zlib.crc32(str(i).encode()) % 10 == 0, WORD.findall(lower(t)) + [None]) for i, t, _ in rows]
    counts = Counter(w for _, held, ws in tokens if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    model = plain_model([(held, ws) for _, held, ws in tokens])
    want = {
        i: (held, len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), model(ws))
        for i, held, ws in tokens
    }
    got = score_texts(docs, block_bytes=5_000, bits=2).collect()
    assert len(got) == len(rows)
    for r in got:
        held, length, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, length, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=0.01)
    assert score_texts(none).count() == 0
    held = spark.createDataFrame([(i, f"w{i} w") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.n_known == r.train_tokens == 0 and r.score < 0 for r in score_texts(held).collect())


def test_distinct_pairs_of_large_numbers():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 9, 200).astype(np.uint64) for _ in range(2))
    for shift in (0, 40):
        x, y = a << np.uint64(shift), b << np.uint64(shift)
        first, second, place = distinct_pairs(x, y)
        assert (first[place] == x).all() and (second[place] == y).all() and len(set(zip(first, second))) == len(first)


@pytest.mark.parametrize(("n", "part", "class_bits", "most"), [(4, 85, 64, 1024), (5, 80, 3, 3), (2, 60, 64, 2)])
def test_jaccard_join(docs, none, rows, n, part, class_bits, most):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(lower(t))
        m = min(n, len(w))
        sets[i] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = jaccard_join(docs, n=n, part=part, class_bits=class_bits, most=most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    assert any(r.component_id != r.doc_id for r in got)
    assert jaccard_join(none).count() == 0


def test_jaccard_join_links_through_documents_without_id(spark):
    words = [f"w{k}" for k in range(100)]
    bridge = words[:96] + [f"x{k}" for k in range(4)]
    far = words[:92] + [f"y{k}" for k in range(4)] + bridge[96:]
    lone = [f"z{k}" for k in range(50)]
    rows = [(5, words), (None, bridge), (None, bridge), (9, far), (None, lone), (None, lone[:-1]), (7, [f"v{k}" for k in range(50)])]
    rows += [(20, [f"u{k}" for k in range(60)]), (None, [f"u{k}" for k in range(58)])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join(docs, n=1, part=90).collect())
    assert got == Counter([(5, 5), (None, 5), (None, 5), (9, 5), (None, None), (None, None), (7, 7), (20, 20), (None, 20)])


def awkward_words():
    """Two words of 1,024 letters, unequal in every place, whose sums of letters times powers of any odd base agree modulo 2**64."""
    sign = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join("ab"[s] for s in sign), "".join("ba"[s] for s in sign)


def test_words_of_equal_sums_stay_apart(spark):
    one, two = awkward_words()
    texts = pa.array([one, two, one + "x", "x" + one, "12345678", "123456781"])
    assert len({h.tobytes() for h in word_hashes(texts)}) == len(texts)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(docs).collect()} == {1: 1, 2: 2, 3: 1}
    scored = {r.doc_id: r.base_score for r in score_texts(docs).collect()}
    assert scored[1] == scored[3] > scored[2]


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_exact_sets(n):
    rng = random.Random(n)
    texts = [b" ".join(rng.choice([b"a", b"b", b"ab", b"\xc3\xa9", b"q%d" % rng.randrange(400)]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    sets = []
    for t in texts:
        w = t.split()
        m = min(n, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set())
    found = exact_sets(texts, n)
    for a, x in zip(sets, found):
        for b, y in zip(sets, found):
            assert len(a & b) == len(np.intersect1d(x, y))


def test_segment_keys_find_every_pair_that_links():
    rng = np.random.default_rng(4)
    rule = Rule(85, 100)
    for sets in (10, 10**9):
        for _ in range(200):
            size = int(rng.integers(1, 200))
            x = rng.integers(1, 2**63, size, dtype=np.uint64)
            keep = x[rng.random(size) > rng.uniform(0, 0.12)]
            y = np.concatenate([keep, rng.integers(1, 2**63, int(rng.integers(0, 12)), dtype=np.uint64)])
            common = len(np.intersect1d(x, y))
            if not len(y) or not rule.links(common, len(x), len(y)):
                continue
            number = max(rule.levels_of(max(len(x), len(y)))[0], 0)
            level = plan_level(rule, number, sets)
            assert number in rule.levels_of(min(len(x), len(y)))
            assert np.intersect1d(segment_keys(x, level), segment_keys(y, level)).size


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((center + rng.standard_normal(16) * rng.choice([0.02, 0.13, 0.2]), int(k % 3)))
    rows.append(rows[0])
    data = [(i, [float(x) for x in v], lb) for i, (v, lb) in enumerate(rows)]
    odd = [None, [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, []]
    n = len(data)
    data += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + len(odd), data[0][1], None)]
    frame = spark.createDataFrame([(*d, "c") for d in data], "vec_id long, embedding array<float>, label int, class string")
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in data[:n]}
    labels = {i: lb for i, _, lb in data}
    parent = {i: i for i, _, _ in data}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    links = Counter()
    for i in vectors:
        for j in vectors:
            if i < j and labels[i] == labels[j] and vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = embedding_dedup(frame).collect()
    assert len(got) == len(data) and sum(links.values()) > 20
    assert sum(r.n_links for r in got) >= 0.9 * sum(links.values())
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], find(r.vec_id), r.vec_id == find(r.vec_id))
    assert embedding_dedup(frame.limit(0)).count() == 0
    assert collision_rule(0.98, 32, 2.0, 0.9999)[1] < 32


def test_collision_counts_leave_few_pairs_and_every_link():
    """Of spread vectors under 5 % of the pairs get the full count and nearly none the cosine; pairs at the threshold stay."""
    rng = np.random.default_rng(3)
    spread = unit(rng.standard_normal((1500, 64)))
    step = rng.standard_normal(spread.shape)
    step -= (step * spread).sum(axis=1, keepdims=True) * spread
    near = 0.98 * spread + math.sqrt(1 - 0.98**2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    share = 0.99995
    half = collision_rule(0.98, 32, 2.0, share)[0]
    rules = [(n, collision_rule(0.98, n, 2.0, share)[1]) for n in (8, 32)]
    a, b = (v @ directions(64, 32) for v in (spread, near))
    pairs = 1500 * 1500
    assert len(passing(a, b, half, rules[:1])[0]) < 0.08 * pairs
    i, j = passing(a, b, half, rules)
    assert (i == j).sum() >= 1499 and len(i) < 1500 + pairs // 1000


def test_embeddings_without_id_and_of_other_lengths(spark):
    near = [1.0, 0.1, 0.0]
    data = [(None, near, 1), (4, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (9, near, 1), (7, near, 2)]
    got = Counter(embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect())
    assert got == Counter({(None, 0, None, True): 2, (2, 0, 2, True): 1, (4, 1, 4, True): 1, (9, 1, 4, False): 1, (7, 0, 7, True): 1})


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
