"""How far reads reach from a variant, as histograms: arrays of (len, n), longest first.

A histogram has no more entries than the longest read has letters, however many reads there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<len:int,n:bigint>>"


def reach_of(reads: Column, side: str) -> Column:
    """The histogram of a list of reads; ``side`` is prefix or suffix."""
    lengths = F.transform(reads, lambda r: F.length(r[side]))

    def counted(x: Column) -> Column:
        return F.transform(F.sort_array(F.array_distinct(x), asc=False), lambda n: F.struct(n.alias("len"), F.size(F.filter(x, lambda y: y == n)).cast("long").alias("n")))

    return F.get(F.transform(F.array(lengths), counted), F.lit(0))


def reads_in(reach: Column) -> Column:
    return F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x["n"])


def covering(reach: Column, n: Column) -> Column:
    """Reads of length ``n`` or more."""
    return reads_in(F.filter(reach, lambda x: x["len"] >= n))


def bases_within(reach: Column, n: Column) -> Column:
    """Bases of all reads within ``n`` of the variant."""
    return F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.least(x["len"], n))


def kth_longest(reach: Column, k: Column) -> Column:
    """Length of the ``k``-th longest read, counted from 1; null if there are fewer."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("len"))
    step = lambda s, x: F.when(s["seen"] >= k, s).otherwise(F.struct((s["seen"] + x["n"]).alias("seen"), x["len"].alias("len")))
    return F.aggregate(reach, start, step, lambda s: F.when((s["seen"] >= k) & (k >= 1), s["len"]))


def tallied(rows: DataFrame, keys: list[str], n: Column, first: Column, weight: Column, left: Column, right: Column) -> DataFrame:
    """Histograms left_reach and right_reach of the rows of each key, with n_source_reads and seen.

    A row stands for ``n`` reads of lengths ``left`` and ``right``, ``weight`` source reads together. Counted by length
    before any list is made, so a key of very many reads spreads over all tasks.
    """
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), left.cast("int").alias("len")), F.struct(F.lit(1).alias("side"), right.cast("int").alias("len"))))
    each = rows.select(*keys, n.cast("long").alias("n"), first.alias("first"), weight.cast("long").alias("weight"), sides.alias("x"))
    by_length = each.groupBy(*keys, "x.side", "x.len").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("weight").alias("weight"))
    return _listed(by_length, keys, F.min("first").alias("seen"), F.sum(F.when(F.col("side") == 0, F.col("weight"))).alias("n_source_reads"))


def _listed(by_length: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("len", "n"))), asc=False)
    return by_length.groupBy(*keys).agg(of(0).alias("left_reach"), of(1).alias("right_reach"), *more)


def added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms and n_source_reads of all rows of a key as one."""
    side = lambda c, k: F.transform(c, lambda x: F.struct(F.lit(k).alias("side"), x["len"].alias("len"), x["n"].alias("n")))
    each = rows.select(*keys, F.explode(F.concat(side("left_reach", 0), side("right_reach", 1))).alias("x"))
    by_length = each.groupBy(*keys, "x.side", "x.len").agg(F.sum("x.n").alias("n"))
    totals = rows.groupBy(*keys).agg(F.sum("n_source_reads").alias("n_source_reads"))
    return _listed(by_length, keys).join(totals, keys)
