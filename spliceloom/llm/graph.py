"""Connected components of a link table, and runs of equal keys in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialize


class Forest:
    """Union-find over any hashable nodes."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a, b) -> bool:
        """Whether ``a`` and ``b`` were apart until now."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows of each key, of batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[-1].column(key)[0].as_py() != values[0].item():
            yield _whole(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            held.append(batch.slice(a, b - a))
            yield _whole(held)
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links that this task holds."""
    for batch in batches:
        forest = Forest()
        kept = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if forest.join(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    Randomised contraction: in each round a node goes to the neighbour (or itself)
    of least rank under a fresh hash, and links are rewritten. The number of nodes
    with links falls by a constant factor a round in expectation, whatever the
    shape of the graph, and a node with many links is only ever an aggregate.
    """
    links = materialize(links.select("a", "b").where("a <> b").mapInArrow(_thin, "a long, b long"), "links")
    maps: list[DataFrame] = []
    while not is_empty(links):
        salt = F.lit(len(maps) + 1)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(salt, "b").alias("rank"), F.col("b").alias("node"))).alias("least"))
        goes = F.when(F.col("least.rank") < F.xxhash64(salt, "a"), F.col("least.node")).otherwise(F.col("a"))
        step = materialize(least.select(F.col("a").alias("node"), goes.alias("to")), "contraction")
        maps.append(step)
        moved = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        links = materialize(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[0]
    for step in maps[1:]:
        further = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        labels = labels.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    labels = materialize(labels, "labels")
    smallest = labels.groupBy("to").agg(F.min("node").alias("component"))
    return labels.join(smallest, "to").select("node", "component")
