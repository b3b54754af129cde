"""Conflict-constrained best-fit packing of documents into training sequences.

Method. Documents longer than a bin are cut into whole bins and a rest. Pieces
are dealt to shards of bounded size; each shard packs its pieces in descending
size. Open bins are ordered by residual room, and each carries bitmaps of the
sources that reached their limit and of the duplicate clusters it holds. The
search starts at the tightest bin with enough room and goes on to its successors
until one is compatible; else a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, squeeze, word_count


def text_cluster(text: Column) -> Column:
    """Cluster of copies: a hash of the lower-cased text without white space; empty texts have none."""
    squeezed = F.lower(squeeze(text))
    return F.when(squeezed != "", F.xxhash64(squeezed))


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """Bin of each piece. Sources and clusters are small numbers; a cluster below 0 conflicts with none."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    crowded: list[int] = []  # bitmap of sources at their limit, by bin
    held: list[int] = []  # bitmap of clusters, by bin
    counts: list[Counter] = []
    bins = [0] * len(sizes)
    for i in order:
        size, source = sizes[i], 1 << sources[i]
        cluster = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (crowded[open_bins[at][1]] & source or held[open_bins[at][1]] & cluster):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(held)
            crowded.append(0)
            held.append(0)
            counts.append(Counter())
        held[b] |= cluster
        counts[b][sources[i]] += 1
        if counts[b][sources[i]] >= per_source:
            crowded[b] |= source
        insort(open_bins, (residual - size, b))
        bins[i] = b
    return bins


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    cluster: Column | None = None,
    text_col: str = "text",
    capacity: int = 2048,
    per_source: int = 2,
    shard_rows: int = 4096,
) -> DataFrame:
    """Pack documents into bins of ``capacity`` tokens.

    No bin holds two pieces of one duplicate cluster (pieces of one document
    count as such), nor more than ``per_source`` pieces of one source. ``size``
    defaults to the number of words of the text, ``cluster`` to ``text_cluster``.

    Returns one row per piece: the id column, source, cluster, piece (from 0),
    offset (tokens before it in its document), size, bin, bin_fill. The whole
    document is packed: sizes of its pieces sum to its size. Documents of size 0
    (null or empty texts) are one piece of size 0 and take a place like others; a
    null source is a source of its own; a null cluster conflicts with none.
    Repeated rows are packed as often as they occur. No rows give no rows. Other
    columns are not read, whatever their names.
    """
    text = F.col(text_col)
    size = word_count(text) if size is None else size
    cluster = text_cluster(text) if cluster is None else cluster
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("total"),
        cluster.cast("long").alias("cluster"),
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / capacity) - 1)
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    offset = F.col("piece") * capacity
    pieces = materialize(
        pieces.select("id", "source", "cluster", "piece", offset.alias("offset"), F.least(F.lit(capacity), F.col("total") - offset).alias("size")),
        "pack-pieces",
    )
    # Read from the written table, the running number is the same in every attempt; with it, rows that
    # are equal in all columns spread over the shards as well.
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.expr(f"pmod(xxhash64(id, piece, monotonically_increasing_id()), {shards})"))

    def pack_shard(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("size", "ascending")]).drop_columns("shard")
        rows = table.select(["id", "source", "cluster", "piece", "size"]).to_pydict()
        # Pieces of one document conflict even where it belongs to no cluster.
        tags = [
            ("cluster", c) if c is not None else ("id", i) if n or s == capacity else None
            for i, c, n, s in zip(rows["id"], rows["cluster"], rows["piece"], rows["size"])
        ]
        often = [t for t, n in Counter(t for t in tags if t is not None).items() if n > 1]
        numbers = {t: k for k, t in enumerate(often)}
        sources = {s: k for k, s in enumerate(dict.fromkeys(rows["source"]))}
        bins = best_fit(rows["size"], [sources[s] for s in rows["source"]], [numbers.get(t, -1) for t in tags], capacity, per_source)
        fill: Counter = Counter()
        for b, size in zip(bins, rows["size"]):
            fill[b] += size
        base = key[0].as_py() << 32
        table = table.append_column("bin", pa.array([base + b for b in bins], pa.int64()))
        return table.append_column("bin_fill", pa.array([fill[b] for b in bins], pa.int64()))

    fields = "id {}, source string, cluster long, piece long, offset long, size long, bin long, bin_fill long"
    schema = fields.format(pieces.schema["id"].dataType.simpleString())
    return dealt.groupBy("shard").applyInArrow(pack_shard, schema).withColumnRenamed("id", id_col)
