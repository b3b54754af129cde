"""Column functions over CIGAR strings: aligned blocks and positions on the read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = "struct<read:bigint,ref:bigint,len:bigint>"


def aligned_blocks(cigar: str, pos: str) -> Column:
    """Gapless blocks (read, ref, len) of an alignment, from 0; ``pos`` counts from 1. Takes column names."""
    return F.expr(
        f"""aggregate(
            zip_with(regexp_extract_all({cigar}, '([0-9]+)([MIDNSHP=X])', 1), regexp_extract_all({cigar}, '([0-9]+)([MIDNSHP=X])', 2),
                     (n, op) -> named_struct('n', bigint(n), 'op', op)),
            named_struct('read', bigint(0), 'ref', bigint({pos} - 1), 'blocks', cast(array() as array<{_BLOCK}>)),
            (s, o) -> named_struct(
                'read', s.read + if(o.op IN ('M', '=', 'X', 'I', 'S'), o.n, bigint(0)),
                'ref', s.ref + if(o.op IN ('M', '=', 'X', 'D', 'N'), o.n, bigint(0)),
                'blocks', if(o.op IN ('M', '=', 'X'), concat(s.blocks, array(named_struct('read', s.read, 'ref', s.ref, 'len', o.n))), s.blocks)),
            s -> s.blocks)"""
    )


def read_length(cigar: str) -> Column:
    """Number of read bases a CIGAR string accounts for. Takes a column name."""
    return F.expr(f"aggregate(regexp_extract_all({cigar}, '([0-9]+)[MIS=X]', 1), bigint(0), (s, n) -> s + bigint(n))")


def clipped_start(cigar: Column) -> Column:
    """Length of the soft clip before the aligned part."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long")


def clipped_end(cigar: Column) -> Column:
    """Length of the soft clip behind the aligned part."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long")


def read_offset(blocks: Column, position: Column) -> Column:
    """Place on the read of a reference position, or null."""
    block = F.get(F.filter(blocks, lambda b: (b["ref"] <= position) & (position < b["ref"] + b["len"])), F.lit(0))
    return block["read"] + position - block["ref"]


def first_overlap(blocks: Column, start: Column, end: Column) -> Column:
    """Index of the first block with a base in [start, end), or null."""
    hits = F.filter(F.sequence(F.lit(0), F.size(blocks) - 1), lambda i: (F.get(blocks, i)["ref"] < end) & (F.get(blocks, i)["ref"] + F.get(blocks, i)["len"] > start))
    return F.when(F.size(blocks) > 0, F.get(hits, F.lit(0)))


def reference_positions(blocks: Column, length: Column) -> Column:
    """Reference position of each base of the read; null where it is inserted or clipped.

    Every block is laid out once, after the unmapped bases before it.
    """
    none = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")), lambda _: F.lit(None).cast("long"))

    def lay(done: Column, b: Column) -> Column:
        return F.concat(done, none(b["read"] - F.size(done)), F.sequence(b["ref"], b["ref"] + b["len"] - 1))

    laid = F.aggregate(F.filter(blocks, lambda b: b["len"] > 0), F.array().cast("array<bigint>"), lay)
    return F.concat(laid, none(length.cast("long") - F.size(laid)))
