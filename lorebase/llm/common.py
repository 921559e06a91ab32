"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorebase-ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the fast path; it gives the same result there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions so that none has much more than ``each`` rows."""
    return max(shuffle_partitions(spark), -(-rows // each))


#: Rows up to which a table of a few numbers a row is broadcast.
BROADCAST_ROWS = 500_000


def sized(small: DataFrame, rows: int) -> DataFrame:
    """``small``, a table of a few numbers a row, marked for broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for every node of the edges a-b that isn't its own smallest."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


#: Edges that one task settles among themselves at the start of a round, some eight megabytes.
TASK_EDGES = 500_000


def _settled(it):
    """Of all edges (a, b) of a partition: (node, root)."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it if b.num_rows]
    if got:
        nodes, roots = local_components(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, long, that isn't its own root; the root is the smallest node reachable.

    In every round tasks of TASK_EDGES edges each replace theirs by the stars of their components, then
    a large-star and a small-star step (joins and aggregations with map-side combine, checkpointed)
    bring the tasks' stars together. It ends with the round whose edges one task has settled, or which
    changes nothing. A round leaves an edge a node and task at most, and nothing is collected. Nulls and
    self-loops are ignored.
    """
    e, seen = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        mark = e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, tasks = mark, max(1, -(-mark[0] // TASK_EDGES))
        stars = checkpointed(e.repartition(tasks).mapInArrow(_settled, "node long, root long"))
        if tasks == 1 and stars.rdd.getNumPartitions() == 1:
            return stars
        both = stars.select(F.col("node").alias("u"), F.col("root").alias("v")).union(stars.select("root", "node"))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # so that AQE can split a hub
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(small.union(least.select("a", "m")).distinct())


_RANGE = 1 << 30


def least_hashed(df: DataFrame, key: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows of ``df`` with the least hash of ``key``: a sample that every run repeats.

    A filter on the hash leaves about twice as many before the ranking, so what meets in one place
    depends on the sample's size and not on the number of tasks.
    """
    place, n = F.pmod(F.xxhash64(key), F.lit(_RANGE)), df.count()
    if n > 2 * most:
        df = df.where(place < int(2 * most / n * _RANGE))
    return df.orderBy(place, key, *ties).limit(most)


def piece(text: Column, key: Column, size: int) -> Column:
    """Up to ``size`` characters of ``text``, from a place that a hash of ``key`` tells: a bounded part of a sampled text."""
    start = F.pmod(F.xxhash64(key, F.lit("piece")), F.greatest(F.length(text) - size, F.lit(0)) + 1)
    return F.substring(text, start.cast("int") + 1, F.lit(size))


def slices(it, rows: int = 512):
    """Arrow batches cut into smaller ones, so that a task holds the texts of ``rows`` rows as Python objects and no more."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Taken:
    """Which spans meet some of ``spans`` (start, end), by binary search."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, b - 1) - 1
        return k >= 0 and self.ends[k] > a
