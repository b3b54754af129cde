"""The query of assembled sequences against a plain run of the assembly, and against a run without it."""

from collections import Counter, defaultdict

import pytest

from spliceloom import queries
from spliceloom.operators import assembly
from spliceloom.operators.assembly import Sequence, assemble


@pytest.fixture(scope="module")
def texts(tmp_path_factory, spark):
    """Documents with copies that differ in their ends and one letter, of two sources."""
    whole = "".join("ACGT"[(k * k * 7 + k // 3) % 4] for k in range(400))
    cut = lambda k: whole[k * 5 : k * 5 + 41 + k % 7]
    rows = [(k, cut(k % 23) if k % 5 else cut(k % 23)[:24] + "A" + cut(k % 23)[25:], "ab"[k % 2]) for k in range(80)]
    path = tmp_path_factory.mktemp("assembled")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def plain(rows):
    """(source, prefix, alt, suffix, reads) of each source's longest assembled sequences."""
    held = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for doc, text, source in rows:
        n, few = len(text) // 2, 8 + doc % 6
        for left, right in ((15, few), (few, 15)):
            held[source][text[n]][text[n - left : n], text[n + 1 : n + 1 + right]].add(doc)
    out = Counter()
    for source, alleles in held.items():
        counts = {a: len({d for x in s.values() for d in x}) for a, s in alleles.items()}
        best = max(counts.values())
        assert [c for c in counts.values()].count(best) == 1
        alt = next(a for a, c in counts.items() if c == best)
        # Numbered as the query does, by the first read that has a sequence.
        first = lambda p, s: min(2 * d + (len(p) < 15) for d in alleles[alt][p, s])
        sequences = sorted(alleles[alt], key=lambda x: first(*x))
        sizes = {k: len(alleles[alt][x]) for k, x in enumerate(sequences)}
        made = assemble([Sequence(p, alt, s, frozenset([k])) for k, (p, s) in enumerate(sequences)], 10, None, sizes)
        longest = min(31, max(len(m.text) for m in made))
        for m in made:
            if len(m.text) >= longest:
                out[source, m.prefix, m.alt, m.suffix, sum(sizes[k] for k in m.reads)] += 1
    return out


def got(spark, path):
    return Counter((r.variant_id, r.prefix, r.alt, r.suffix, r.n_reads) for r in queries.assembled_sequences(spark, path).collect())


def test_assembled_sequences_against_a_plain_run(spark, texts):
    path, rows = texts
    found = got(spark, path)
    assert found == plain(rows)
    assert all(len(p + a + s) == 31 for _, p, a, s, _ in found)


def test_assembly_decides_what_follows(spark, texts, monkeypatch):
    path, _ = texts
    assembled = got(spark, path)
    whole = assembly.assemble_groups
    monkeypatch.setattr(assembly, "assemble_groups", lambda unique, least, limit: whole(unique, least, 0))
    # Reads of one reach used to be no longer or shorter than each other, so nothing was ever merged.
    assert got(spark, path) != assembled
    monkeypatch.undo()
    monkeypatch.setattr(assembly, "assemble_groups", lambda unique, least, limit: whole(unique, least, limit, 0))
    assert got(spark, path) == assembled
