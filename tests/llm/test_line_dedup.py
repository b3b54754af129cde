"""Line dedup against a loop over lines, and its SQL."""

import random
import re
from collections import defaultdict

from spliceloom.llm.line_dedup import line_dedup

EDGE = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
SCHEMA = "doc_id long, text string, id string, row string, line string, key string, place int, n long"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), EDGE.sub("", line))


def brute(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key_of(line)) >= 40:
                holders[key_of(line)].add(doc)
    keepers = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keepers.get(key_of(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", 1, 2) for r in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(frame).collect()), key=repr)


def make_rows(seed=2):
    rng = random.Random(seed)
    shared = [f"Shared line number {k} " + "wörter und so weiter " * 2 for k in range(12)] + ["short line"]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(0, 12)):
            x = rng.choice(shared) if rng.random() < 0.6 else f"own {rng.random()} " + "x" * rng.randint(0, 60)
            lines.append(rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  \f"]))
        rows.append((doc, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n"), (63, "\n\n"), (None, shared[0] + "\n" + shared[1]), (64, "\n".join([shared[0]] * 3000 + ["own"] + [shared[1]] * 10))]
    rows += [rows[3], rows[3], (3, shared[2] + "\nanother text of the same id")]
    rows += [(100 + k, "é" * 39 + " \n" + "é" * 40 + "\nA" + "b" * 39) for k in range(5)]
    rows += [(200, "Z" * 2_000_000), *((201 + k, "z" * 2_000_000) for k in range(4))]
    return rows


def test_against_loop(spark):
    rows = make_rows()
    assert run(spark, rows) == brute(rows)


def test_four_documents_are_too_few(spark):
    rows = [(k, "a line that is certainly longer than forty characters") for k in range(4)]
    assert [r[2] for r in run(spark, rows)] == [0, 0, 0, 0]
    assert [r[2] for r in run(spark, [*rows, (4, rows[0][1])])] == [1, 1, 1, 1, 0]


def test_no_rows(spark):
    assert run(spark, []) == []
