"""Left alignment of a read's insertions and deletions, in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = "array<struct<kind:string,n:bigint,read:bigint,mapped:bigint,free:bigint,gone:bigint>>"


def indel_runs(cigar: Column) -> Column:
    """Insertions and deletions of a CIGAR string, in order.

    Fields: kind (I or D), n, read (bases of the read before it), mapped (aligned bases before it), free (those of them
    since the last indel) and gone (deleted bases before it). Adjacent ones of a kind are one.
    """
    numbers, kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    ops = F.zip_with(numbers, kinds, lambda n, op: F.struct(n.cast("long").alias("n"), op.alias("op")))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("read"), zero.alias("mapped"), zero.alias("free"), zero.alias("gone"), F.array().cast(_RUN).alias("runs"))

    def step(s: Column, o: Column) -> Column:
        aligned, n = o["op"].isin("M", "=", "X"), o["n"]
        indel = o["op"].isin("I", "D")
        last = F.get(s["runs"], F.size(s["runs"]) - 1)
        again = (s["free"] == 0) & (last["kind"] == o["op"])
        run = F.struct(o["op"].alias("kind"), n.alias("n"), s["read"].alias("read"), s["mapped"].alias("mapped"), s["free"].alias("free"), s["gone"].alias("gone"))
        longer = F.struct(last["kind"].alias("kind"), (last["n"] + n).alias("n"), *[last[c].alias(c) for c in ("read", "mapped", "free", "gone")])
        kept = F.slice(s["runs"], F.lit(1), F.greatest(F.size(s["runs"]) - 1, F.lit(0)))
        runs = F.when(~indel, s["runs"]).when(F.coalesce(again, F.lit(False)), F.concat(kept, F.array(longer))).otherwise(F.concat(s["runs"], F.array(run)))
        return F.struct(
            (s["read"] + F.when(aligned | o["op"].isin("I", "S"), n).otherwise(0)).alias("read"),
            (s["mapped"] + F.when(aligned, n).otherwise(0)).alias("mapped"),
            F.when(indel, zero).when(aligned, s["free"] + n).otherwise(s["free"]).alias("free"),
            (s["gone"] + F.when(o["op"] == "D", n).otherwise(0)).alias("gone"),
            runs.cast(_RUN).alias("runs"),
        )

    return F.aggregate(ops, start, step, lambda s: s["runs"])


def reference_bases(mapped: Column, md: Column) -> Column:
    """Struct (kept, gone): reference bases where the read is aligned and where it has deletions, from its aligned bases and MD tag.

    Bases that the tag says nothing of are spaces in ``kept`` and missing at the end of ``gone``.
    """
    tokens = F.regexp_extract_all(F.upper(md), F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    start = F.struct(F.lit("").alias("kept"), F.lit("").alias("gone"))

    def step(s: Column, t: Column) -> Column:
        gap, number = F.startswith(t, F.lit("^")), t.rlike("^[0-9]")
        kept = F.when(gap, F.lit("")).when(number, F.substring(mapped, F.length(s["kept"]) + 1, t.try_cast("int"))).otherwise(t)
        return F.struct(F.concat(s["kept"], kept).alias("kept"), F.concat(s["gone"], F.when(gap, F.substring(t, F.lit(2), F.length(t))).otherwise(F.lit(""))).alias("gone"))

    return F.aggregate(tokens, start, step, lambda s: F.struct(F.rpad(s["kept"], F.length(mapped), F.lit(" ")).alias("kept"), s["gone"].alias("gone")))


def left_aligned_interval(seq: Column, cigar: Column, md: Column, blocks: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Struct (start, end) of where an indel of the read lies on it, if the indel or one of its left shifts is the trimmed variant.

    An indel moves left by one as long as the base before it equals its last one. So it moves by ``k`` exactly if the
    ``k`` bases before it and the ``k`` bases that end it, in one text, are the same; the variant's position says which
    ``k`` to look at. The first such indel counts; null if there is none. The reference bases come from the MD tag.
    """
    mapped = F.array_join(F.transform(blocks, lambda b: F.substring(seq, (b["read"] + 1).cast("int"), b["len"].cast("int"))), "")

    def with_bases(x: Column) -> Column:
        return F.transform(F.array(F.struct(reference_bases(x["mapped"], x["md"]).alias("bases"))), lambda y: F.get(F.filter(F.transform(x["runs"], lambda r: found(x, y["bases"], r)), lambda z: z.isNotNull()), F.lit(0)))

    def found(x: Column, bases: Column, r: Column) -> Column:
        inserted = r["kind"] == "I"
        # The aligned base behind which the variant lies, counted over the aligned bases.
        at = x["pos"] - F.when(inserted, 1).otherwise(2)
        before = F.filter(x["blocks"], lambda b: b["ref"] <= at)
        block = F.get(before, F.size(before) - 1)
        behind = F.aggregate(F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, b: s + b["len"]) + at - block["ref"]
        k = F.when(at < block["ref"] + block["len"], r["mapped"] - 1 - behind)
        text = F.when(inserted, F.substring(x["seq"], (r["read"] + 1).cast("int"), r["n"].cast("int"))).otherwise(
            F.rpad(F.substring(bases["gone"], (r["gone"] + 1).cast("int"), r["n"].cast("int")), r["n"].cast("int"), F.lit("N"))
        )
        joined = F.concat(F.substring(bases["kept"], (r["mapped"] - r["free"] + 1).cast("int"), r["free"].cast("int")), text)
        part = lambda start, n: F.substring(joined, (start + 1).cast("int"), n.cast("int"))
        shift = r["free"] - k
        moves = part(shift, k) == part(shift + r["n"], k)
        moved = part(shift, r["n"])
        is_it = F.when(inserted, (x["ref"] == "") & (x["alt"] == moved)).otherwise((x["alt"] == "") & (x["ref"] == moved))
        start = r["read"] - k
        end = start + F.when(inserted, r["n"]).otherwise(0)
        return F.when((k >= 0) & (k < r["free"]) & moves & is_it, F.struct(start.alias("start"), end.alias("end")))

    bound = F.struct(
        seq.alias("seq"), md.alias("md"), mapped.alias("mapped"), blocks.alias("blocks"), indel_runs(cigar).alias("runs"), pos.alias("pos"), ref.alias("ref"), alt.alias("alt")
    )
    return F.get(F.flatten(F.transform(F.array(bound), with_bases)), F.lit(0))
