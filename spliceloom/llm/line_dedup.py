"""Line dedup: lines that many documents hold stay in one of them.

Method. Texts are exploded into lines, normalised to keys and hashed; distinct
documents are counted by hash, and the lines of frequent keys go. Row and key are
128-bit digests, so texts move only once, to meet the places of their dropped
lines; what lies between these places is joined again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize

# The letters that keys have in lower case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key counts as hot if it has this share of all lines or more; so there are at most as many hot keys.
HOT_SHARE = 1024


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def without_places(lines: Column, places: Column) -> Column:
    """The array without the elements at ``places`` (sorted, from 0), as runs between them."""
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1) + 1)
    stop = lambda k: F.coalesce(F.get(places, k), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda k: F.slice(lines, start(k) + 1, stop(k) - start(k))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 40, min_docs: int = 5) -> DataFrame:
    """Texts without the lines that many documents share.

    A line's key is the line without white space at both ends, A-Z in lower case.
    Keys of ``min_points`` code points or more that are in ``min_docs`` documents or
    more (different ids) lose their lines in all documents but the one of the largest
    id. Lines of that document stay, all of them.

    Returns one row for each row: the id column, n_lines, n_dropped and kept (the text of
    the other lines).

    A null or empty text is one empty line. A text that loses every line is empty.
    Repeated rows of an id count as one document, and each loses its own lines. A row
    without id is no document, so it neither counts nor keeps frequent lines. No rows
    give no rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull().cast("string"), F.col("text")))))

    lines = rows.select("id", "row", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.where(F.length("line") >= min_points).withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_points)
    lines = materialize(lines.select("id", "row", "place", F.unhex(F.md5("line")).alias("key")), "lines")

    counted = lines.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    frequent = materialize(counted, "frequent-lines")
    hot = frequent.where(F.col("n") * HOT_SHARE >= lines.count()).drop("n")
    found = lines.join(F.broadcast(hot), "key").unionByName(
        lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(frequent.drop("n"), "key")
    )
    dropped = found.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("places"))

    # The lines stand behind a generator, else every step of the lambda would split the text again.
    joined = rows.join(dropped, "row", "left").select("id", "places", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    places = F.coalesce("places", F.array().cast("array<int>"))
    return joined.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(places).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("places").isNull(), F.col("lines")).otherwise(without_places(F.col("lines"), F.col("places"))), "\n").alias("kept"),
    )
