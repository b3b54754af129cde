"""Mixing sources to target weights with a low-discrepancy schedule.

Method. Each source's documents are laid end to end in shuffled order and cut
into blocks of equally many words. The schedule has as many slots as all
sources need together; slot n has the golden-ratio point n/phi mod 1, which
falls into one source's part of the cumulative weights. Slots are ranked per
source, and rank r takes block r mod (number of blocks), so a source is read
again only after all of it was read. What is taken is what the slots take: a
slot beyond its source's need takes nothing, and a source that got too few stays
short by these. The golden ratio's points are so even that this is a logarithm of
the number of slots; random points would miss by its square root.

Blocks grow with the input, so that there are about ``SLOTS`` slots at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

# Fixed value: 2**32 divided by the golden ratio, an odd number.
GOLDEN = 2_654_435_769
SPAN = 1 << 32
#: Slots of a schedule, about: bounds the schedule's tables and a target's relative error.
SLOTS = 1 << 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Targets of the sources: (sid, source, source_size, weight, target).

    ``sizes`` has one row per source with ``source_size``. Sources in code-point
    order (null last) get the weights in turn and share the sum of all sizes. A
    target stops at ``max_repeats`` times the source's size and the excess goes
    to the others by weight: the water level is found in one pass over the
    sources in the order in which they fill.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    named = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % n + 1).cast("int"))
    )
    full = F.col("source_size") * max_repeats
    filling = Window.orderBy((full / F.col("weight")).asc(), "sid")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = named.withColumn("level", level).withColumn("level", F.when(F.col("level") <= full / F.col("weight"), F.col("level")))
    water = levels.withColumn("water", F.max("level").over(everything))
    target = F.least(full.cast("double"), F.coalesce(F.col("water") * F.col("weight"), full.cast("double")))
    return water.select("sid", "source", "source_size", "weight", target.alias("target"))


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """Whole words and slots each source needs, and its part of the 2**32 points."""
    plan = targets.withColumn("quota", F.floor(F.col("target") + 0.5)).where("quota > 0")
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("last_pass", F.expr("quota div source_size"))
    left = F.col("quota") - F.col("last_pass") * F.col("source_size")
    plan = plan.withColumn("slots", F.col("last_pass") * F.col("blocks") + F.ceil(left / block))
    order = Window.orderBy("sid")
    total = F.sum("slots").over(Window.partitionBy())
    upto = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return plan.withColumn("hi", F.floor(upto / total * SPAN)).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0)))


def schedule(spark: SparkSession, plan: DataFrame, chunk: int = 4096, bins: int = 12) -> DataFrame:
    """Slots of the mix in order: (slot, sid, rank); each source has about as many as its plan says."""
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).cast("long")).first()[0]
    n = F.col("id")
    high, low = F.shiftright(n, 16).bitwiseAND(F.lit(0xFFFF)), n.bitwiseAND(F.lit(0xFFFF))
    point = ((high * GOLDEN) % (1 << 16) * (1 << 16) + low * GOLDEN) % SPAN
    points = spark.range(total).select(n.alias("slot"), point.alias("point"), F.shiftright(point, 32 - bins).alias("bin"))
    parts = plan.select("sid", "lo", "hi", F.explode(F.expr(f"sequence(lo >> {32 - bins}, (hi - 1) >> {32 - bins})")).alias("bin")).where(
        "hi > lo"
    )
    owned = points.join(parts, "bin").where("point >= lo AND point < hi").select("slot", "sid", F.expr(f"slot div {chunk}").alias("chunk"))
    counts = owned.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = owned.withColumn("k", F.row_number().over(within)).join(counts, ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("base") + F.col("k") - 1).alias("rank"))
    return materialize(ranked.select("slot", "sid", "rank"), "mix-slots")


def place_documents(sized: DataFrame, buckets: int = 4096, seed: int = 17) -> DataFrame:
    """``sized`` (sid, id, size) with ``start``, the words before it in its source's shuffled order.

    Two levels of sums: buckets of the shuffle key within the source, then rows
    within the bucket, so that no task holds a whole source.
    """
    keyed = sized.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("bucket", F.expr(f"pmod(h, {buckets})"))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(sums, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("h", "bucket", "base", "inner")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block: int | None = None,
) -> DataFrame:
    """Words of each document that the mix takes, with its source's target.

    Returns one row per input row: the id column, size (words), source, source_size,
    target, taken. ``block`` is the number of words of a block, of which
    ``SLOTS`` or fewer cover all words if it is not given, 16 words at least.
    Runs agree for equal rows. Null or empty texts have size 0 and
    are taken 0 times; a null source is a source of its own; a source without
    words has target 0. Repeated rows each have a place of their own. No rows give
    no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes"
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    targets = materialize(targets.coalesce(1), "mix-targets")
    if block is None:
        words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
        block = max(16, -(-words // SLOTS))
    plan = materialize(_plan(targets, block).coalesce(1), "mix-plan")

    slots = schedule(spark, plan).join(plan.select("sid", "source_size", "quota", "blocks"), "sid")
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("pass", F.expr("rank div blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("quota") - F.col("pass") * F.col("source_size") - F.col("block") * block
    slots = slots.withColumn("length", length).withColumn("words", F.greatest(F.lit(0), F.least(length, left)))
    takes = slots.groupBy("sid", "block").agg(
        F.count(F.when(F.col("words") == F.col("length"), 1)).alias("whole"),
        F.coalesce(F.sum(F.when(F.col("words") < F.col("length"), F.col("words"))), F.lit(0)).alias("part"),
    )

    same = sized["source"].eqNullSafe(targets["source"])
    rows = sized.join(targets.drop("weight"), same).select("sid", targets["source"], "source_size", "target", "id", "size")
    placed = place_documents(rows.where("size > 0"))
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    lo = F.greatest("start", F.col("block") * block)
    end = F.col("start") + F.col("size")
    overlap = F.least(end, (F.col("block") + 1) * block) - lo
    part = F.greatest(F.lit(0), F.least(end, F.col("block") * block + F.col("part")) - lo)
    words = F.coalesce(F.col("whole") * overlap + part, F.lit(0))
    key = ["sid", "start", "id", "size", "source", "source_size", "target"]
    taken = pieces.join(takes, ["sid", "block"], "left").groupBy(*key).agg(F.sum(words).alias("taken"))
    empty = rows.where("size = 0").withColumn("taken", F.lit(0))
    columns = [F.col("id").alias(id_col), "size", "source", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return taken.select(*columns).unionByName(empty.select(*columns))
