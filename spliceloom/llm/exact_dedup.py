"""Exact deduplication over an extendible-hash index on shared files.

Method. The index has one entry per 64-bit key of the normalised text and
SHA-256 (its chain link), pre-aggregated before any shuffle, so a group of
copies of any size is one entry. The directory starts with one bucket; a bucket
that holds more than ``capacity`` entries is split by one more bit of the key,
and the directory doubles until its depth is that of its deepest bucket. Each
entry goes through the directory to its bucket. An owner task holds whole
buckets: it orders them by key, chains the entries of one key, and writes them
to shared files. Rows find their chain link through the directory as well, and
a row's group is its link.

Bytes are compared by grouping the normalised texts themselves: two texts share
a link only if they are equal byte by byte. Should one link ever hold two texts,
it is split by text. Links with very many rows are not shuffled to: at most
``HOT`` of them can have more than 1/``HOT`` of the rows, and these are broadcast.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import is_empty, materialize, squeeze

#: Bits of the key by which entries are counted at a time.
STEP = 16
HOT = 20_000
#: Slots of a directory that is broadcast; a larger one is joined by shuffle.
SMALL_DIRECTORY = 1 << 18


def _prefix(key: Column | str, depth: int) -> Column:
    """Leading bits; Spark shifts by 64 as by 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def split_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory of the index, (slot, depth, bucket), and its depth: a slot is a prefix of so many bits.

    ``keys`` has one row per entry with its ``key``. A bucket is split while it
    holds more than ``capacity`` entries, up to all bits of the key, beyond which
    entries of one key form a chain. Each round counts only what is still overfull.
    """
    buckets: list[DataFrame] = []
    depth = bits = 0
    live, counts = keys, None
    while True:
        if counts is None or depth > bits:
            if counts is not None:
                live = live.join(counts.select(F.col("slot").alias("over")), _prefix("key", bits) == F.col("over"), "left_semi")
            bits = min(64, bits + STEP)
            counts = materialize(live.groupBy(_prefix("key", bits).alias("slot")).agg(F.count("*").alias("n")), "dedup-counts")
        bucket = F.shiftrightunsigned("slot", bits - depth) if depth else F.lit(0).cast("long")
        placed = counts.withColumn("bucket", bucket)
        held = materialize(placed.groupBy("bucket").agg(F.sum("n").alias("held")), "dedup-held")
        fits = F.lit(depth == 64) | (F.col("held") <= capacity)
        buckets.append(held.where(fits).select("bucket", F.lit(depth).alias("depth")))
        if is_empty(held.where(~fits)):
            break
        counts = materialize(placed.join(held.where(~fits), "bucket", "left_semi").select("slot", "n"), "dedup-counts")
        depth += 1
    own = F.expr(f"{depth} - depth")
    slots = F.sequence(F.call_function("shiftleft", F.col("bucket"), own), F.call_function("shiftleft", F.col("bucket") + 1, own) - 1)
    if depth == 64:  # only full keys are that deep
        slots = F.when(F.col("depth") == 64, F.array("bucket")).otherwise(slots)
    directory = reduce(DataFrame.unionByName, buckets).select(F.explode(slots).alias("slot"), "depth", "bucket")
    return materialize(directory, "dedup-directory"), depth


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 16_384,
) -> DataFrame:
    """Group rows whose texts are equal without white space; one row of each group stays.

    Returns one row per input row: the id column, keep_id, group_size, kept,
    text_sha256, and of the index: bucket_depth, bucket and chain_link. The row
    with most code points stays, then the one with the smallest id (a null id
    comes last).

    Null text counts as empty; empty texts form a group. Of rows that repeat id
    and length, one is kept. No rows give no rows. Other columns of ``docs`` are
    not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    normal = squeeze(F.col("text"))
    index = materialize(
        rows.select(
            "id",
            F.length("text").cast("long").alias("points"),
            F.xxhash64(normal).alias("key"),
            F.unhex(F.sha2(normal, 256)).alias("sha"),
        ),
        "dedup-index",
    )

    texts = rows.select(normal.alias("normal")).distinct()
    links = texts.select(F.xxhash64("normal").alias("key"), F.unhex(F.sha2("normal", 256)).alias("sha"))
    best = index.groupBy("key", "sha").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("u"), F.col("id").alias("id"))).alias("best"),
    )
    proven = links.groupBy("key", "sha").agg(F.count("*").alias("n_texts"))
    entries = materialize(best.join(proven, ["key", "sha"]), "dedup-entries")

    directory, depth = split_directory(entries.select("key"), capacity)
    if directory.count() <= SMALL_DIRECTORY:
        directory = F.broadcast(directory)
    routed = lambda frame: frame.withColumn("slot", _prefix("key", depth)).join(directory, "slot").drop("slot")

    owned = routed(entries).repartition("depth", "bucket")
    chain = Window.partitionBy("depth", "bucket", "key").orderBy("sha")
    chains = owned.withColumn("link", F.row_number().over(chain)).sortWithinPartitions("depth", "bucket", "key", "link")
    chains = materialize(chains, "dedup-chains")

    out = _members(index, routed, chains.where("n_texts = 1"))
    mixed = chains.where("n_texts > 1")
    if not is_empty(mixed):
        out = out.unionByName(_split_links(rows, mixed))
    return out.withColumnRenamed("id", id_col)


def _members(index: DataFrame, routed, chains: DataFrame) -> DataFrame:
    """Rows of the index with the decision of their chain link, which they reach through the directory."""
    place = ["depth", "bucket", "key", "sha"]
    found = chains.select(*place, "link", "group_size", F.col("best.id").alias("keep_id"), F.col("best.p").alias("p"))
    large = F.col("group_size") > max(1000, index.count() // HOT)
    hot = F.broadcast(found.where(large))
    rest = index.join(hot.select("key", "sha"), ["key", "sha"], "left_anti")
    return _decide(routed(index).join(hot, place).unionByName(routed(rest).join(found.where(~large), place)))


def _decide(joined: DataFrame) -> DataFrame:
    wins = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == -F.col("p"))
    lone = _one_of_repeats(joined.where(wins & (F.col("group_size") > 1)))
    rest = joined.where(~wins | (F.col("group_size") == 1)).withColumn("kept", F.col("group_size") == 1)
    return _shape(rest.unionByName(lone))


def _one_of_repeats(winners: DataFrame) -> DataFrame:
    """Winners that repeat id and text differ in nothing: one of them is kept."""
    counted = winners.groupBy(*winners.columns).agg(F.count("*").alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.withColumn("kept", F.col("copy") == 1).drop("n", "copy")


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("depth").alias("bucket_depth"),
        "bucket",
        F.col("link").alias("chain_link"),
    )


def _split_links(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of the links that hold several texts, told apart by the texts themselves."""
    normal = squeeze(F.col("text"))
    wide = rows.select(
        "id",
        F.length("text").cast("long").alias("points"),
        F.xxhash64(normal).alias("key"),
        F.unhex(F.sha2(normal, 256)).alias("sha"),
        normal.alias("normal"),
    ).join(mixed.select("key", "sha", "depth", "bucket", "link"), ["key", "sha"])
    best = wide.groupBy("key", "normal").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("u"), F.col("id").alias("id"))).alias("best"),
    )
    joined = wide.join(best, ["key", "normal"]).withColumn("keep_id", F.col("best.id")).withColumn("p", F.col("best.p")).drop("best")
    return _decide(joined)
