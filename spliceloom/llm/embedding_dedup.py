"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Method. Unit vectors are projected on many random directions. Two vectors at
distance d differ by a normal with deviation d on each, so vectors above the
cosine threshold fall into each other's window on most projections. For each
query vector and projection, the window of values around it is a run of the
sorted projection; a pair's collisions are counted over the projections, and
pairs with enough of them are verified by cosine in double precision. The count
is the largest that a pair at the threshold still reaches with the wanted recall.
It is asked for twice: of the first ``FIRST`` projections, by which a few in a
hundred pairs are left, and of all projections of those.

Plan. Only equal labels are compared. Two leading projections cut each label's
vectors into cells so wide that vectors above the threshold lie in the same or
neighbouring cells but for a chance below the recall's; large cells are cut into
blocks. A task compares two blocks and sends back each vector's number of links
and a spanning forest, never the pairs. Equal vectors of one label are one class,
grouped by the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import Forest, components, runs

BLOCK = 512
FIRST = 8
#: At most so many classes can have more than 1/HOT of the rows.
HOT = 5_000


def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(dim * 1009 + 5).standard_normal((dim, count))


def collision_rule(cosine: float, count: int, window: float, recall: float) -> tuple[float, int]:
    """Half width of the windows, and the collisions a pair needs; ``window`` is in deviations at the threshold."""
    half = window * math.sqrt(2 - 2 * cosine)
    p = math.erf(window / math.sqrt(2))
    least, tail = count + 1, 0.0
    while tail < recall and least:
        least -= 1
        tail += math.comb(count, least) * p**least * (1 - p) ** (count - least)
    return half, least


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def collisions(queries: np.ndarray, values: np.ndarray, half: float) -> np.ndarray:
    """Number of projections (columns) in whose query-centred window each value lies."""
    counts = np.zeros((len(queries), len(values)), dtype=np.uint8)
    for q, v in zip(queries.T, values.T):
        order = np.argsort(v, kind="stable")
        place = np.empty(len(v), dtype=np.int16)
        place[order] = np.arange(len(v), dtype=np.int16)
        low = np.searchsorted(v[order], q - half, side="left").astype(np.int16)
        high = np.searchsorted(v[order], q + half, side="right").astype(np.int16)
        counts += (place >= low[:, None]) & (place < high[:, None])
    return counts


def _read(batch: pa.RecordBatch, column: str) -> np.ndarray:
    data = batch.column(column)
    return np.frombuffer(b"".join(v.as_buffer() for v in data), dtype=np.float64).reshape(len(data), -1)


def passing(queries: np.ndarray, values: np.ndarray, half: float, rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with enough collisions: ``rules`` has numbers of leading projections and the collisions they ask for, in order."""
    done, least = rules[0]
    counts = collisions(queries[:, :done], values[:, :done], half)
    i, j = np.nonzero(counts >= least)
    held = counts[i, j].astype(np.int64)
    for count, least in rules[1:]:
        held += (np.abs(queries[i, done:count] - values[j, done:count]) <= half).sum(axis=1)
        enough = held >= least
        i, j, held, done = i[enough], j[enough], held[enough], count
    return i, j


def placed(classes: DataFrame, width: float) -> DataFrame:
    """Classes with their cell on two leading projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((len(batch), 2), dtype=np.int64)
            vectors = [v.values.to_numpy(zero_copy_only=False) for v in batch.column("vector")]
            lengths = np.array([len(v) for v in vectors])
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                cells[at] = np.floor(unit(np.stack([vectors[i] for i in at])) @ directions(n, 2) / width)
            arrays = [batch.column(k) for k in range(3)] + [pa.array([v.tobytes() for v in vectors], pa.binary()), *map(pa.array, cells.T)]
            yield pa.RecordBatch.from_arrays(arrays, ["class", "space", "copies", "data", "x", "y"])

    schema = "class long, space string, copies long, data binary, x long, y long"
    return classes.select("class", "space", "copies", "vector").mapInArrow(run, schema)


def tiled(cells: DataFrame) -> DataFrame:
    """(tile, side, class, copies, data): blocks of the same or neighbouring cells, each pair of blocks once."""
    cell = ["space", "x", "y"]
    sizes = cells.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    rows = cells.join(sizes.drop("n"), cell).withColumn("part", F.expr("pmod(xxhash64(class, 3), blocks)"))
    blocks = sizes.withColumn("part", F.explode(F.expr("sequence(0, blocks - 1)"))).select(*cell, F.col("part").cast("long").alias("part"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = blocks.select(*cell, "part", F.explode(offsets).alias("o"))
    near = near.select("space", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("part").alias("ap"), (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    a, b = F.struct("ax", "ay", "ap"), F.struct("x", "y", "part")
    pairs = near.join(blocks, cell).where(a <= b)
    tile = F.xxhash64("space", "ax", "ay", "ap", "x", "y", "part")
    first = pairs.select(tile.alias("tile"), F.lit(0).alias("side"), "space", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("ap").alias("part"))
    second = pairs.where(a < b).select(tile.alias("tile"), F.lit(1).alias("side"), *cell, "part")
    return rows.join(first.unionByName(second), [*cell, "part"]).select("tile", "side", "class", "copies", "data")


def compared(members: DataFrame, cosine: float, half: float, rules: list[tuple[int, int]]) -> DataFrame:
    """Rows (a, b, links): number of vectors that class a links with in a tile (b null), and forest links."""

    def compare(group: pa.RecordBatch) -> tuple[list, list, list]:
        side = group.column("side").to_numpy()
        ids, copies = group.column("class").to_numpy(), group.column("copies").to_numpy()
        vectors = unit(_read(group, "data"))
        values = vectors @ directions(vectors.shape[1], rules[-1][0])
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if side.any() else one
        i, j = passing(values[one], values[two], half, rules)
        i, j = one[i], two[j]
        if two is one:
            i, j = i[i < j], j[i < j]
        ok = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= cosine
        i, j = i[ok], j[ok]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(links)
        forest = Forest()
        kept = [(a, b) for a, b in zip(ids[i].tolist(), ids[j].tolist()) if forest.join(a, b)]
        return (
            [*ids[some].tolist(), *(a for a, _ in kept)],
            [*[None] * len(some), *(b for _, b in kept)],
            [*links[some].astype(np.int64).tolist(), *[0] * len(kept)],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "tile"):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in compare(group)], ["a", "b", "links"])

    return members.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(run, "a long, b long, links long")


def embedding_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    projections: int = 32,
    window: float = 2.0,
    recall: float = 0.9999,
) -> DataFrame:
    """Links of vectors with equal labels and a cosine of ``cosine`` or more, and their components.

    Returns one row per input row: the id column, n_links (other vectors linked
    directly, copies counted each), component_id (smallest id reachable) and kept.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    vectors without label, and rows without id link with nothing. Vectors of
    different lengths never link. Rows that repeat a vector and label are linked
    with each other. No rows give no rows. Other columns are not read, whatever
    their names.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label")
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    space = F.when(F.coalesce(usable, F.lit(False)), F.concat_ws(":", F.size("vector").cast("string"), "label"))
    rows = rows.select("id", space.alias("space"), "vector")
    classes = rows.where("space IS NOT NULL").groupBy("space", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "embedding-classes")

    # Half of what recall may lose goes to each of the two counts.
    share = 1 - (1 - recall) / 2
    counts = sorted({min(FIRST, projections), projections})
    half = collision_rule(cosine, projections, window, share)[0]
    rules = [(n, collision_rule(cosine, n, window, share)[1]) for n in counts]
    width = 5.5 * math.sqrt(2 - 2 * cosine)
    cells = materialize(placed(classes, width), "embedding-cells")
    found = materialize(compared(tiled(cells), cosine, half, rules), "embedding-links")
    direct = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class")

    full = classes.select("class", "copies", "id").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    full = materialize(full.join(direct, "class", "left"), "embedding-components")
    smallest = full.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = full.join(smallest, "component").select("class", "component_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    by_vector = classes.select("space", "vector", "class").join(by_class, "class").drop("class")
    # Vectors with very many copies are not shuffled to.
    large = F.col("copies") > max(1000, rows.count() // HOT)
    hot = F.broadcast(by_vector.where(large))
    rest = rows.join(hot.select("space", "vector"), ["space", "vector"], "left_anti")
    out = rows.join(hot, ["space", "vector"]).unionByName(rest.join(by_vector.where(~large), ["space", "vector"], "left"))
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
