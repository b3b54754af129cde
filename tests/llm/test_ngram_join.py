"""Work of the n-gram join: keys that unrelated sets share, groups of keys, comparisons within a group."""

import numpy as np
import pytest

from spliceloom.llm import ngram_join
from spliceloom.llm.ngram_join import Rule, group_parts, near_pairs, parity_bitmap, plan_level, segment_keys, spanning


@pytest.mark.parametrize("number", [8, 9, 11, 13])
def test_unrelated_sets_of_all_sizes_of_a_level_share_few_keys(number):
    rule, rng = Rule(80, 100), np.random.default_rng(5)
    level = plan_level(rule, number, 60_000)
    low, high = rule.edges(number)
    sizes = np.geomspace(rule.least_partner(low), high - 1, 600).astype(int)
    keys = np.concatenate([segment_keys(rng.integers(0, 2**63, n, dtype=np.uint64), level) for n in sizes])
    held = np.unique(keys, return_counts=True)[1]
    # The smallest sets used to send their empty segments, which all of them share: thousands of pairs, by the square of the sets.
    assert (held * (held - 1) // 2).sum() < 600


@pytest.mark.parametrize("crossed", [False, True])
@pytest.mark.parametrize("at_once", [1, 100, 1 << 17])
def test_near_pairs_against_every_pair(crossed, at_once, monkeypatch):
    monkeypatch.setattr(ngram_join, "_AT_ONCE", at_once)
    rule, rng = Rule(80, 100), np.random.default_rng(6)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    sets = [np.unique(np.append(base[: int(n)][rng.random(int(n)) > 0.1], rng.integers(0, 2**63, 3, dtype=np.uint64))) for n in rng.integers(1, 700, 80)]
    sizes, side = np.array([len(x) for x in sets]), rng.integers(0, 2, len(sets))
    found = {}
    for i, others in near_pairs(sizes, [parity_bitmap(x) for x in sets], side, crossed, rule):
        for j in others.tolist():
            assert (i, j) not in found and (j, i) not in found
            found[i, j] = True
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            common = len(np.intersect1d(x, y))
            asked = not crossed or side[i] != side[j]
            if rule.links(common, len(x), len(y)) and asked:
                assert (i, j) in found or (j, i) in found
            assert asked or ((i, j) not in found and (j, i) not in found)
    links = spanning(iter([(0, np.array([1, 2])), (1, np.array([2, 3])), (3, np.array([4]))]), np.array([0, 1, 2, 3, 0]), lambda i, j: (i, j) != (0, 1))
    assert links == [(0, 2), (1, 2), (1, 3)]


def test_parts_of_groups(spark):
    rng = np.random.default_rng(7)
    wanted = {k: set(rng.integers(0, 10**6, n).tolist()) for k, n in enumerate([1, 2, 3, 9, 40, 1, 5])}
    rows = [(k, m) for k, ms in wanted.items() for m in ms for _ in range(int(rng.integers(1, 4)))]
    rows = [rows[x] for x in rng.permutation(len(rows))]
    got = group_parts(spark.createDataFrame(rows, "key long, class long"), 4).collect()
    for r in got:
        assert len(set(r.members)) == len(r.members) <= 4
    for k, ms in wanted.items():
        parts = [r for r in got if r.key == k]
        assert {m for r in parts for m in r.members} == (ms if len(ms) > 1 else set())
        assert sorted(r.part for r in parts) == list(range(len(parts)))
