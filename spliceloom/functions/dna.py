"""Column functions over nucleotide strings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amino acids of the 64 codons in TCAG order, stop codons as '*'.
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Start codons of nuclear genes (the last seven are non-canonical) and of vertebrate mitochondria.
STARTS = ("ATG", "CTG", "TTG", "GTG", "AGG", "ACG", "AAG", "ATC", "ATA", "ATT")
MITOCHONDRIAL_STARTS = ("ATT", "ATC", "ATA", "ATG", "GTG")
MITOCHONDRIAL_CONTIGS = ("chrm", "m", "chrmt", "mt")


def codon_table(mitochondrial: bool = False) -> dict[str, str]:
    """Amino acid of each codon; vertebrate mitochondria read TGA as W and ATA as M."""
    table = dict(zip(map("".join, product(BASES, repeat=3)), STANDARD))
    return table | {"TGA": "W", "ATA": "M"} if mitochondrial else table


def start_codons(mitochondrial: bool = False) -> tuple[str, ...]:
    return MITOCHONDRIAL_STARTS if mitochondrial else STARTS


def is_mitochondrial(contig: Column) -> Column:
    return F.lower(contig).isin(*MITOCHONDRIAL_CONTIGS)


def reverse_complement(c: Column) -> Column:
    """Reverse complement; anything but A, C, G, T is an error."""
    done = F.reverse(F.translate(c, "ACGT", "TGCA"))
    return F.when(c.rlike("^[ACGT]*$") | c.isNull(), done).otherwise(F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), c)))


def left_part(c: Column, n: Column) -> Column:
    """First ``n`` characters; none for n <= 0."""
    return F.substring(c, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def right_part(c: Column, n: Column) -> Column:
    """Last ``n`` characters; none for n <= 0."""
    kept = F.least(F.greatest(n, F.lit(0)), F.length(c)).cast("int")
    return F.substring(c, (F.length(c) - kept + 1).cast("int"), kept)


def slice_text(c: Column, begin: Column, end: Column) -> Column:
    """Characters from ``begin`` to before ``end``, counted from 0; both are cut to the text."""
    a = F.least(F.greatest(begin, F.lit(0)), F.length(c)).cast("int")
    b = F.least(F.greatest(end, a), F.length(c)).cast("int")
    return F.substring(c, (a + 1).cast("int"), (b - a).cast("int"))


def after_last_n(c: Column) -> Column:
    """What follows the last N: the usable end of a prefix."""
    return F.regexp_replace(c, "^.*N", "")


def before_first_n(c: Column) -> Column:
    """What precedes the first N: the usable start of a suffix."""
    return F.substring_index(c, "N", 1)


def letters(c: Column) -> Column:
    """Array of single characters; empty for an empty text."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions over the common length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(letters(left_part(a, n)), letters(left_part(b, n)), lambda x, y: x != y)
    return F.size(F.filter(pairs, lambda differs: differs))


def mismatches_before(reference: Column, found: Column) -> Column:
    """Hamming distance of equally long prefixes; unequal lengths are an error."""
    return F.when(F.length(reference) == F.length(found), hamming(reference, found)).otherwise(F.raise_error(F.lit("prefixes differ in length")))


def mismatches_after(reference: Column, found: Column) -> Column:
    """Differences after the variant; what the read has beyond the reference counts as well."""
    return hamming(reference, found) + F.greatest(F.lit(0), F.length(found) - F.length(reference))


def _codon_text(mitochondrial: bool) -> tuple[str, str]:
    """All codons in one text, each before a space, and their amino acids at the codons' places; place 1 is for unknown ones."""
    table = codon_table(mitochondrial)
    return "? " + " ".join(table), "? " + "".join(f"{a}   " for a in table.values())


def translate(cdna: Column, mitochondrial: Column | None = None, first_is_start: Column | None = None) -> Column:
    """Struct (amino_acids, ends_with_stop) of a coding sequence up to its first stop codon.

    One or two trailing nucleotides are ignored, as is all behind the stop. Both
    fields are null if an unknown codon comes before.
    """

    def by_table(m: bool) -> Column:
        codons, acids = map(F.lit, _codon_text(m))
        at = lambda i: F.call_function("locate", F.substring(cdna, i, F.lit(3)), codons)
        text = F.array_join(F.transform(places, lambda i: F.substring(acids, F.greatest(at(i), F.lit(1)), F.lit(1))), "")
        if first_is_start is None:
            return text
        starts = first_is_start & F.substring(cdna, 1, 3).isin(*start_codons(m))
        return F.when(starts, F.concat(F.lit("M"), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)

    n = F.floor(F.length(cdna) / 3).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(1), n * 3 - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
    protein = by_table(False) if mitochondrial is None else F.when(mitochondrial, by_table(True)).otherwise(by_table(False))

    def cut(whole: Column) -> Column:
        acids = F.substring_index(whole, "*", 1)
        known = ~F.contains(acids, F.lit("?"))
        return F.struct(F.when(known, acids).alias("amino_acids"), F.when(known, F.contains(whole, F.lit("*"))).alias("ends_with_stop"))

    # The protein is made once and bound to a name.
    return F.get(F.transform(F.array(protein), cut), F.lit(0))


def frame_to_offset(frame: Column) -> Column:
    """Nucleotides to skip to the next complete codon, from the reading frame of the first."""
    return (3 - frame) % 3


def kmers(c: Column, k: int) -> Column:
    """All distinct substrings of length ``k``."""
    n = F.length(c) - k + 1
    places = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(k))))


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y; 0 over anything is 0, and anything else over 0 is infinite."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(float("inf"))).otherwise(x / y)
