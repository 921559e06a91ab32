"""Document fingerprints: threshold-scaled sketches of word shingles, DataFrame operations only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range and no other, so
sketches of texts of any length compare directly, and the union of two is the sketch of both texts
together. A text of few shingles may keep none; what that gives is stated with ``likeness``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tasks_for

SHINGLE = 5
FRACTION = 1 / 4
_EDGE = -(1 << 63) + int(FRACTION * (1 << 64))


def _words(text: Column) -> Column:
    whole = F.btrim(text, F.lit(" \n\t\r\f\x0b"))
    return F.when(F.octet_length(whole) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, r"\s+"))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add column ``name``: the ascending retained hashes of ``text``'s shingles (one of all words, if they are fewer)."""
    df = df.withColumn("_w", _words(F.col(text))).withColumn("_n", F.size("_w"))
    w = F.col("_w")
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    df = df.withColumn("_h", F.when(F.col("_n") == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(F.filter(each, lambda x: x < F.lit(_EDGE))))))
    return df.withColumnRenamed("_h", name).drop("_w", "_n")


def merged(a: Column, b: Column) -> Column:
    """The sketch of the shingles of two texts together."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller in the larger: 0 to 1; 1 for two empty sketches, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def _previous(ids: DataFrame) -> DataFrame:
    """Ring of ``ids(doc_id, mark, n)`` by descending doc_id (nulls last): each with its predecessor's key and n.

    Only keys are dealt out by range; a window orders each part, and one row a part closes the ring.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").asc()]
    count = ids.count()
    parts = checkpointed(ids.repartitionByRange(tasks_for(ids.sparkSession, count, 500_000), *order).withColumn("part", F.spark_partition_id()))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "mark", "doc_id", "n")
    ends = parts.groupBy("part").agg(F.max(rank).alias("last"))
    around = Window.orderBy("part")  # one row for each part
    before = F.coalesce(F.lag("last").over(around), F.last("last").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.select("part", before.alias("before"))
    inside = Window.partitionBy("part").orderBy(*order)
    own = parts.withColumn("prev", F.lag(F.struct("doc_id", "mark", "n")).over(inside)).join(F.broadcast(ends), "part")
    pick = lambda k: F.when(F.col("prev").isNull(), F.col(f"before.{k}")).otherwise(F.col(f"prev.{k}"))
    return own.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), pick("doc_id").alias("prev_id"), pick("mark").alias("prev_mark"), pick("n").alias("prev_n"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The next document is the next distinct (doc_id, text) by descending doc_id, nulls last, then by a
    hash of the text; after the last comes the first, and a lone document is its own next. Rows equal
    in both get equal results. Null text is empty: its sketch is empty, as that of a very short text may
    be; of two empty ones the likeness is 1, of one 0. Whole texts are sketched, however long. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    keys = rows.select("doc_id", "mark", F.length("text").cast("long").alias("n"))
    ids = checkpointed(keys.distinct())
    ring = checkpointed(_previous(ids))
    sketched = with_sketch(rows, "text", "sketch")
    moved = sketched.join(ring, sketched.doc_id.eqNullSafe(ring.d) & (sketched.mark == ring.m))
    moved = moved.select("prev_id", "prev_mark", F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n") / 3).cast("int")).alias("head"), F.col("sketch").alias("next_sketch"))
    if ids.count() < keys.count():
        moved = moved.groupBy("prev_id", "prev_mark").agg(F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch"))
    both = sketched.join(moved, sketched.doc_id.eqNullSafe(moved.prev_id) & (sketched.mark == moved.prev_mark))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    both = with_sketch(both.withColumn("edited", edited), "edited", "edited_sketch")
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
