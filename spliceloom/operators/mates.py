"""Merging reads of one fragment that overlap at a locus."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import stage_table

Key = tuple[int, int]


@dataclass(frozen=True)
class Read:
    sequence: str
    positions: tuple[int | None, ...]
    qualities: tuple[int, ...]
    start: int
    end: int
    count: int


def base_keys(positions: tuple[int | None, ...]) -> list[Key] | None:
    """A key of each base that sorts it on the reference axis; null if no base is mapped.

    Mapped bases have even first numbers. Bases between them carry the odd number
    behind the last mapped base (before the first one, in front of it) and count up.
    """
    first = next((k for k, p in enumerate(positions) if p is not None), None)
    if first is None:
        return None
    keys: list[Key] = [(2 * positions[first] - 1, k) for k in range(first)]
    last, run = positions[first], 0
    for p in positions[first:]:
        if p is None:
            keys.append((2 * last + 1, run))
            run += 1
        else:
            last, run = p, 0
            keys.append((2 * p, 0))
    return keys


def merge_pair(a: Read, b: Read) -> Read | None:
    """One read over both, or null: they must share a base, and a tie of qualities on different bases refuses."""
    ka, kb = base_keys(a.positions), base_keys(b.positions)
    if ka is None or kb is None or not set(ka) & set(kb):
        return None
    merged: dict[Key, tuple[str, int, int | None]] = dict(zip(ka, zip(a.sequence, a.qualities, a.positions)))
    for key, base, quality, position in zip(kb, b.sequence, b.qualities, b.positions):
        old = merged.get(key)
        if old is None:
            merged[key] = base, quality, position
        elif old[0] == base:
            merged[key] = base, max(old[1], quality), position
        elif old[1] == quality:
            return None
        elif quality > old[1]:
            merged[key] = base, quality, position
    order = sorted(merged)
    place = {key: k for k, key in enumerate(order)}
    spans = []
    for keys, read in ((ka, a), (kb, b)):
        if read.start < read.end:
            spans.append((place[keys[read.start]], place[keys[read.end - 1]] + 1))
        else:
            # An empty interval at either end of its read goes to that end of the merged one.
            at = 0 if read.start == 0 else len(order) if read.start == len(keys) else place[keys[read.start]]
            spans.append((at, at))
    full = [s for s in spans if s[0] < s[1]]
    start, end = (min(s[0] for s in full), max(s[1] for s in full)) if full else spans[0]
    bases, qualities, positions = zip(*(merged[k] for k in order))
    return Read("".join(bases), positions, qualities, start, end, a.count + b.count)


def _order(read: Read) -> tuple[bool, int, int, int]:
    """By first and last mapped base and length; reads without mapped bases come last."""
    mapped = [p for p in read.positions if p is not None] or [0]
    return all(p is None for p in read.positions), mapped[0], mapped[-1], len(read.sequence)


def merge_group(reads: list[Read]) -> list[Read]:
    """Merge pairs, in order of place, until no pair merges."""
    left = sorted(reads, key=_order)
    changed = True
    while changed:
        changed, done = False, []
        while left:
            head = left.pop(0)
            for k, other in enumerate(left):
                if (both := merge_pair(head, other)) is not None:
                    head, changed = both, True
                    del left[k]
                    break
            done.append(head)
        left = sorted(done, key=_order)
    return left


def _laid_out(reads: DataFrame) -> DataFrame:
    """A row for each base of the reads of pairs, with its key (``base_keys``) and whether it begins or ends the read's interval.

    Reads come as ``_read`` 0 and 1 of (variant_id, name), and all of this stays in the partition that counted them.
    """
    zipped = F.arrays_zip(F.split("sequence", "").alias("base"), F.col("quality_scores").alias("quality"), F.col("reference_positions").alias("position"))
    bases = reads.select("variant_id", "name", "_read", "read_base0_start", "read_base0_end", F.posexplode(zipped).alias("k", "b"))
    whole = Window.partitionBy("variant_id", "name", "_read")
    upto = whole.orderBy("k")
    position, k = F.col("b.position"), F.col("k")
    bases = bases.withColumns(
        {
            "last": F.last(position, ignorenulls=True).over(upto),
            "last_k": F.last(F.when(position.isNotNull(), k), ignorenulls=True).over(upto),
            "first": F.min_by(position, F.when(position.isNotNull(), k)).over(whole),
        }
    )
    last = F.col("last")
    return bases.where("first IS NOT NULL").select(
        "variant_id", "name", "_read",
        F.when(position.isNotNull(), 2 * position).when(last.isNull(), 2 * F.col("first") - 1).otherwise(2 * last + 1).alias("key"),
        F.when(position.isNotNull(), 0).when(last.isNull(), k).otherwise(k - F.col("last_k") - 1).cast("int").alias("nth"),
        "b.base", "b.quality", "b.position",
        (k == F.col("read_base0_start")).alias("begins"),
        (k == F.col("read_base0_end") - 1).alias("ends"),
    )


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """``merge_group`` of names with two reads each at a locus, as aggregations over their bases; reads that don't merge stay.

    Bases of equal key agree, or the better one wins; different ones of equal quality refuse. ``pairs`` has all columns
    of locus reads.
    """
    whole = Window.partitionBy("variant_id", "name")
    mapped = F.filter("reference_positions", lambda x: x.isNotNull())
    place = F.struct(F.size(mapped) == 0, F.coalesce(F.get(mapped, F.lit(0)), F.lit(0)), F.coalesce(F.get(mapped, F.size(mapped) - 1), F.lit(0)), F.length("sequence"))
    # The first by place takes the lower ordinal.
    ordered = whole.orderBy(place, "read_ordinal")
    reads = pairs.withColumns({"_low": F.min("read_ordinal").over(whole), "_high": F.max("read_ordinal").over(whole), "_read": F.row_number().over(ordered) - 1})
    reads = reads.withColumn("read_ordinal", F.when(F.col("_read") == 0, F.col("_low")).otherwise(F.col("_high"))).drop("_low", "_high")

    of = lambda n, c: F.max(F.when(F.col("_read") == n, F.col(c)))
    keys = ("variant_id", "name")
    met = _laid_out(reads).groupBy(*keys, "key", "nth").agg(
        F.count("*").alias("n"),
        F.max(F.struct("quality", "base")).alias("best"),
        F.min("quality").alias("worse"),
        F.count_distinct("base").alias("bases"),
        F.max("position").alias("position"),
        *[of(n, c).alias(f"{c}_{n}") for c in ("begins", "ends") for n in (0, 1)],
    )
    flags = [f"{c}_{n}" for c in ("begins", "ends") for n in (0, 1)]
    base = F.struct("key", "nth", F.col("best.base").alias("base"), F.col("best.quality").alias("quality"), "position", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])
    conflict = (F.col("n") == 2) & (F.col("bases") == 2) & (F.col("worse") == F.col("best.quality"))
    merged = met.groupBy(*keys).agg(F.sort_array(F.collect_list(base)).alias("m"), F.max(F.col("n") == 2).alias("shared"), F.max(conflict).alias("refused"))
    merged = merged.where("shared AND NOT refused").select(*keys, "m")

    # Merged or not, a pair is met once: what its bases make is not worked out again for those that stay.
    first = reads.where("_read = 0").drop("_read")
    second = reads.where("_read = 1").select(*keys, F.struct(*pairs.columns).alias("_second"))
    joined = first.join(second, list(keys)).join(merged, list(keys), "left")
    size = F.size("m")

    def at(flag: str) -> Column:
        return F.array_position(F.transform("m", lambda x: x[flag]), F.lit(True)) - 1

    def span(n: int, start: Column, end: Column, length: Column) -> tuple[Column, Column, Column]:
        empty = F.when(start == 0, F.lit(0)).when(start == length, size).otherwise(at(f"begins_{n}"))
        full = start < end
        return full, F.when(full, at(f"begins_{n}")).otherwise(empty).cast("long"), F.when(full, at(f"ends_{n}") + 1).otherwise(empty).cast("long")

    a_full, a_start, a_end = span(0, F.col("read_base0_start"), F.col("read_base0_end"), F.length("sequence"))
    b_full, b_start, b_end = span(1, F.col("_second.read_base0_start"), F.col("_second.read_base0_end"), F.length("_second.sequence"))
    pick = lambda both, a, b: F.when(a_full & b_full, both(a, b)).when(b_full & ~a_full, b).otherwise(a)
    of_base = lambda f: F.transform("m", lambda x: x[f])
    new = {
        "sequence": F.array_join(of_base("base"), ""),
        "reference_positions": of_base("position"),
        "quality_scores": of_base("quality"),
        "source_read_count": F.col("source_read_count") + F.col("_second.source_read_count"),
        "read_base0_start": pick(F.least, a_start, b_start),
        "read_base0_end": pick(F.greatest, a_end, b_end),
    }
    one = F.struct(*[new[c].cast(pairs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in pairs.columns])
    apart = F.array(F.struct(*pairs.columns), F.col("_second"))
    return joined.select(F.explode(F.when(F.col("m").isNotNull(), F.array(one)).otherwise(apart)).alias("r")).select("r.*")


def merge_mates(reads: DataFrame) -> DataFrame:
    """Locus reads with overlapping reads of one name at one locus merged.

    A merged read takes the first read's ordinal. Names with two reads are merged by aggregations; only those with more,
    as supplementary alignments make them, go through ``merge_group`` one by one.
    """
    counted = stage_table(reads.withColumn("_n", F.count("*").over(Window.partitionBy("variant_id", "name"))), "reads-by-name")
    # Two reads without a name are no pair.
    unnamed = "(variant_id IS NULL OR name IS NULL)"
    single, several = counted.where(f"_n = 1 OR _n = 2 AND {unnamed}").drop("_n"), counted.where("_n > 2").drop("_n")

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["read_ordinal"])
        found = [
            Read(r["sequence"], tuple(r["reference_positions"]), tuple(r["quality_scores"]), r["read_base0_start"], r["read_base0_end"], r["source_read_count"])
            for r in rows
        ]
        out = []
        for k, read in enumerate(merge_group(found)):
            out.append(
                rows[0]
                | {
                    "read_ordinal": rows[k]["read_ordinal"],
                    "sequence": read.sequence,
                    "reference_positions": list(read.positions),
                    "quality_scores": list(read.qualities),
                    "source_read_count": read.count,
                    "read_base0_start": read.start,
                    "read_base0_end": read.end,
                }
            )
        return pa.Table.from_pylist(out, schema=table.schema)

    merged = several.groupBy("variant_id", "name").applyInArrow(merge, reads.schema)
    return single.unionByName(merge_pairs(counted.where(f"_n = 2 AND NOT {unnamed}").drop("_n"))).unionByName(merged)
