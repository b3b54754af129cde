"""Repair of conversations against a plain search over all edits, from the end."""

import functools
import hashlib
import random
import re
import zlib

from spliceloom.llm.conversations import choices, damage, digest_turns, repair_conversations, walk_trie

ACCEPTED = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, id string, kind int, digest string, audit string"


def cheapest(symbols):
    """Least cost and least edits, by trying every edit before every row; ``roles`` is all that was kept so far."""

    @functools.lru_cache(maxsize=None)
    def whole(at, roles, run):
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return None
        found = [(0, "")] if at == len(symbols) and ACCEPTED.fullmatch(roles) else []
        ways = [(2, "I", at, roles + r, run + 1) for r in "ua"] if run < 3 else []
        if at < len(symbols):
            fault, initial = symbols[at]
            late = fault == "truncated"
            ways.append((3, "D", at + 1, roles, 0))
            if fault not in ("blank", "duplicate"):
                ways += [(late, "K", at + 1, roles + initial, 0)] if initial in ("s", "u", "a") else []
                ways += [(2 + late, "R", at + 1, roles + r, 0) for r in "ua"]
        for cost, edit, *state in ways:
            if (after := whole(*state)) is not None:
                found.append((after[0] + cost, edit + after[1]))
        return min(found, default=None)

    return whole(0, "", 0)


def brute(rows):
    """Contract of the query, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            role = "user" if code == 4 else role
            turns += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
        md5 = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), md5(t[1], t[2])))
        seen, symbols = set(), []
        for _, role, text in turns:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((fault, role[:1]))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(symbols))
        mended, at = [], 0
        for edit in audit:
            following = "assistant" if mended and mended[-1][0][:1] == "u" else "user"
            if edit == "I":
                mended.append((following, ""))
                continue
            _, role, text = turns[at]
            at += 1
            if edit in "KR":
                mended.append((role if edit == "K" else following, text))
        assert ACCEPTED.fullmatch("".join(role[:1] for role, _ in mended))
        counts = [sum(f == x for f, _ in symbols) for x in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in mended).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def make_rows(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(160):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            text = rng.choice(["yes.", "no", "", None, " \t\n", "what?\n ", "ein Satz ohne Ende", "é!", "x. ", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
        if conv % 7 == 0:
            rows += rows[-2:]  # repeated rows
    rows += [(None, k, "user", "no id.") for k in range(3)]
    rows += [(1000, k, "user" if k % 2 == 0 else "assistant", f"long {k}.") for k in range(120)]
    rows += [(1001 + c, k, "user" if k % 2 == 0 else "assistant", f"same {k}.") for c in range(60) for k in range(4)]
    return rows


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA)
    audits, turns = repair_conversations(damage(frame), frame)
    digests = {r[0]: r[1] for r in digest_turns(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    found = audits.collect()
    assert len(found) == len({r[0] for r in found})
    return {r[0]: (*r[1:], digests.get(r[0], empty)) for r in found}


def test_edits_of_damaged_conversations(spark):
    rows = make_rows()
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == {}


def test_every_short_signature():
    """All signatures of up to three symbols, sorted, through one trie."""
    symbols = {"D": ("blank", "u")} | {s: ("", s) for s in "suax"} | {s.upper(): ("truncated", s) for s in "suax"}
    names = sorted(symbols)
    signatures = sorted(["", *names, *(a + b for a in names for b in names), *(a + b + c for a in names for b in names for c in names)])
    for signature, found in zip(signatures, walk_trie(iter(signatures)), strict=True):
        assert found == cheapest(tuple(symbols[s] for s in signature)), signature


def test_long_random_signatures():
    rng = random.Random(1)
    symbols = {"D": ("blank", "u")} | {s: ("", s) for s in "suax"} | {s.upper(): ("truncated", s) for s in "suax"}
    signatures = sorted("".join(rng.choice("DsuaxSUAX" if k % 2 else "ua") for _ in range(rng.randint(4, 24))) for k in range(300))
    for signature, found in zip(signatures, walk_trie(iter(signatures)), strict=True):
        assert found == cheapest(tuple(symbols[s] for s in signature)), signature
    assert all(cost >= 0 for _, _, _, cost in choices("u"))
