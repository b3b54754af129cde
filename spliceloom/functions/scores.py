"""Scores and differences of short sequences."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import letters


def least_alignment(a: str, b: str, min_length: int = 1) -> int:
    """Least cost of laying equally long parts of two sequences on each other.

    Each trimmed character costs 1, as does each mismatch; there are no gaps.
    Without a pair of parts of ``min_length`` the cost is that of trimming all.
    """
    best = len(a) + len(b)
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        wrong = [a[k] != b[k - shift] for k in range(lo, hi)]
        # A column kept saves the two trims, less 1 if it is a mismatch; each end takes its best start.
        score = [0]
        for w in wrong:
            score.append(score[-1] + (2 - w))
        low = None
        for end in range(min_length, len(wrong) + 1):
            start = score[end - min_length]
            low = start if low is None else min(low, start)
            best = min(best, len(a) + len(b) - (score[end] - low))
    return best


def alignment_score(a: Column, b: Column, min_length: int = 1) -> Column:
    """``least_alignment`` of two columns; null if either is null.

    A column that is kept saves at least 1, so the best part of a diagonal is all of it: its cost is the sum of both
    lengths, less 2 for each column, plus its mismatches.
    """

    def least(x: Column) -> Column:
        n_a, n_b = F.size(x["a"]), F.size(x["b"])

        def cost(shift: Column) -> Column:
            low = F.greatest(F.lit(0), shift)
            n = F.least(n_a, n_b + shift) - low
            wrong = F.size(F.filter(F.zip_with(F.slice(x["a"], low + 1, n), F.slice(x["b"], low - shift + 1, n), lambda p, q: p != q), lambda differs: differs))
            return F.when(n >= min_length, n_a + n_b - 2 * n + wrong)

        shifts = F.when((n_a > 0) & (n_b > 0), F.sequence(1 - n_b, n_a - 1)).otherwise(F.array().cast("array<int>"))
        return F.least(n_a + n_b, F.coalesce(F.array_min(F.transform(shifts, cost)), n_a + n_b))

    # Bound to a name: the lambda would split both texts for each shift.
    both = F.array(F.struct(letters(a).alias("a"), letters(b).alias("b")))
    return F.when(a.isNotNull() & b.isNotNull(), F.get(F.transform(both, least), F.lit(0))).cast("int")


def edit_runs(reference: Column, found: Column, offset: Column) -> Column:
    """``differences`` of equally long texts as an array of structs (start, end, alt); unequal lengths are an error."""

    def runs(x: Column) -> Column:
        places = F.when(F.size(x["same"]) > 0, F.sequence(F.lit(0), F.size(x["same"]) - 1)).otherwise(F.array().cast("array<int>"))
        differs = lambda i: ~F.coalesce(F.get(x["same"], i), F.lit(True))
        starts, ends = F.filter(places, lambda i: differs(i) & ~differs(i - 1)), F.filter(places, lambda i: differs(i) & ~differs(i + 1))
        run = lambda s, e: F.struct((x["offset"] + s).alias("start"), (x["offset"] + e + 1).alias("end"), F.substring(x["found"], s + 1, e - s + 1).alias("alt"))
        return F.zip_with(starts, ends, run)

    same = F.zip_with(letters(reference), letters(found), lambda p, q: p == q)
    bound = F.array(F.struct(same.alias("same"), found.alias("found"), offset.cast("int").alias("offset")))
    return F.when(F.length(reference) == F.length(found), F.get(F.transform(bound, runs), F.lit(0))).otherwise(
        F.when(reference.isNotNull() & found.isNotNull(), F.raise_error(F.lit("texts differ in length")))
    )


def differences(reference: str, found: str, offset: int = 0, keep_ends: bool = True) -> list[tuple[int, int, str]]:
    """Edits (start, end, alt) that turn ``reference`` into ``found``; ``offset`` shifts their places.

    Equally long texts differ in maximal runs of mismatches. Others are matched
    block by block; ``keep_ends`` = False leaves out insertions and deletions at
    either end.
    """
    if len(reference) == len(found):
        edits, k = [], 0
        while k < len(found):
            end = k
            while end < len(found) and reference[end] != found[end]:
                end += 1
            if end > k:
                edits.append((offset + k, offset + end, found[k:end]))
            k = max(end, k + 1)
        return edits
    edits = []
    for tag, a, z, b, y in SequenceMatcher(None, reference, found, autojunk=False).get_opcodes():
        at_end = (a == 0 and b == 0) or (z == len(reference) and y == len(found))
        if tag != "equal" and (keep_ends or tag == "replace" or not at_end):
            edits.append((offset + a, offset + z, found[b:y]))
    return edits
