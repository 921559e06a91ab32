"""Sinks: keyed upsert, partition replacement, versioned tables behind a one-row pointer, job resume."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def replace_partition(df: DataFrame, path: str, by: str, rebuilt: DataFrame | None = None) -> None:
    """Rewrite the partitions that ``df`` has rows for; those of ``rebuilt(by)`` that it has none for are emptied.

    An emptied partition keeps a file without rows, so that readers see one write.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if rebuilt is not None:
        schema = df.drop(by)
        for row in rebuilt.select(by).distinct().join(df.select(by).distinct(), by, "left_anti").toLocalIterator():
            schema.limit(0).write.mode("overwrite").parquet(f"{path}/{by}={row[0]}")


def publish(df: DataFrame, root: str, counts: dict[str, int] | None = None) -> str:
    """Write a new version under ``root`` and point to it; readers see the old one until the pointer row is there.

    The pointer is a table to which one small row is appended, so a failure in between leaves the old
    version in place. Versions are numbered, not timed. Returns the version's name.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    number = 1 + max((r.number for r in _pointer(spark, root).collect()), default=0) if _exists(spark, f"{root}/pointer") else 1
    row = spark.createDataFrame([(version, sum((counts or {}).values()), number)], "version string, skipped long, number long")
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _pointer(spark: SparkSession, root: str) -> DataFrame:
    """One row: the highest number."""
    return spark.read.parquet(f"{root}/pointer").agg(F.coalesce(F.max("number"), F.lit(0)).alias("number"))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was published last with nothing skipped."""
    pointer = spark.read.parquet(f"{root}/pointer").where("skipped = 0")
    version = pointer.agg(F.max_by("version", F.struct("number", "version"))).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}")


def active_tier(spark: SparkSession, chunks: DataFrame, first: str, second: str) -> DataFrame:
    """Vectors of the second tier once it covers every chunk of ``chunks(chunk_id)``, else those of the first.

    The first is built at once, the second behind it; readers change over when nothing is missing.
    """
    if _exists(spark, f"{second}/pointer"):
        vectors = current(spark, second)
        if chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti").isEmpty():
            return vectors
    return current(spark, first)


def append_section_item(text: str, heading: str, item: str) -> str:
    """``item`` as a bullet at the end of the ``## heading`` block, which is made if it is missing."""
    lines = text.rstrip("\n").split("\n") if text else []
    at = next((k for k, line in enumerate(lines) if line.strip() == f"## {heading}"), None)
    if at is None:
        return "\n".join([*lines, *([""] if lines else []), f"## {heading}", "", f"- {item}", ""])
    end = next((k for k in range(at + 1, len(lines)) if lines[k].startswith("## ")), len(lines))
    while end > at + 1 and not lines[end - 1].strip():
        end -= 1
    return "\n".join([*lines[:end], f"- {item}", *lines[end:], ""])
