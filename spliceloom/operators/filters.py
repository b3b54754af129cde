"""Filters as columns: rows are annotated, never dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Default thresholds and flags.
DEFAULT_THRESHOLDS = {
    "min_num_alt_reads": 3,
    "min_num_alt_fragments": 2,
    "min_fraction_alt_reads": 0.005,
    "min_fraction_alt_fragments": 0.005,
    "max_num_ref_reads": 10**9,
    "max_num_ref_fragments": 10**9,
    "max_fraction_ref_reads": 1.0,
    "max_fraction_ref_fragments": 1.0,
    "max_num_other_reads": 10**9,
    "max_num_other_fragments": 10**9,
    "max_fraction_other_reads": 0.5,
    "max_fraction_other_fragments": 0.5,
    "min_ratio_alt_to_other_fragments": 3.0,
}
DEFAULT_FLAGS = ("predicted_effect_modifies_protein_sequence", "has_mutant_protein_sequence_from_rna", "protein_sequence_contains_mutation")
PREFIX = "filter:"


def threshold(df: DataFrame, name: str, value: float) -> Column:
    """min_<column> is >= value, max_<column> is <= value; null fails."""
    kind, _, column = name.partition("_")
    if kind not in ("min", "max"):
        raise ValueError(f"a threshold starts with min_ or max_: {name}")
    if column not in df.columns:
        raise ValueError(f"no column {column} for {name}")
    c = F.col(f"`{column}`")
    return F.coalesce(c >= value if kind == "min" else c <= value, F.lit(False))


def flag(df: DataFrame, name: str) -> Column:
    """<column>, or not_<column>; null counts as false before it is negated."""
    column = name.removeprefix("not_") if name not in df.columns else name
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if not isinstance(df.schema[column].dataType, BooleanType):
        raise ValueError(f"{column} is not boolean")
    c = F.coalesce(F.col(f"`{column}`"), F.lit(False))
    return c if column == name else ~c


def with_filters(df: DataFrame, thresholds: Mapping[str, float] = DEFAULT_THRESHOLDS, flags: Sequence[str] = DEFAULT_FLAGS) -> DataFrame:
    """A column filter:<name> for each flag and threshold, and passes_all_filters over all filter columns."""
    new = {PREFIX + f: flag(df, f) for f in flags} | {PREFIX + t: threshold(df, t, v) for t, v in thresholds.items()}
    out = df.drop("passes_all_filters").withColumns(new)
    passes = F.lit(True)
    for c in out.columns:
        if c.startswith(PREFIX):
            passes &= F.col(f"`{c}`")
    return out.withColumn("passes_all_filters", passes)
