"""Exact nearest neighbours of vectors by pivot cells.

Every vector belongs to the cell of its nearest pivot, with its distance to it. A question first visits the
nearest cells that hold k vectors together; its k-th distance there is a limit, and by the triangle
inequality no vector of a cell beyond it can be among the k nearest, nor one whose distance to its pivot
differs from the question's by more. So questions and vectors meet by an exchange on cells; neither goes
through the driver, and a cell with many vectors is dealt in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .retrieval import sized

#: Pivots at most (they are sent to every task), vectors of a cell's part, questions scored at once.
PIVOTS, PART, AT_ONCE = 256, 20_000, 128


def _sphere(x: np.ndarray, metric: str) -> np.ndarray:
    """What distances are taken between: for cosine the points on the unit sphere."""
    if metric != "cosine":
        return x
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _low(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of each question and vector what is to be small: the distance, or the cosine with its sign turned; to six digits."""
    dots = q @ x.T
    if metric == "cosine":
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
        return -np.round(np.clip(np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0), -1, 1), 6)
    square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None]
    far = np.maximum(square - 2 * dots, 0.0)
    close = np.argwhere(far < 1e-6 * square)  # where the difference of large numbers says little
    for i, j in close:
        far[i, j] = ((q[i] - x[j]) ** 2).sum()
    return np.round(np.sqrt(far), 6)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _by_length(column: pa.Array):
    """(rows, matrix) of the vectors of each length but zero."""
    lengths, flat = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for n in np.unique(lengths):
        if n:
            rows = np.flatnonzero(lengths == n)
            yield int(n), rows, flat[starts[rows][:, None] + np.arange(n)]


def _chosen(vectors: DataFrame, metric: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (cells, pivots): some vectors, by the hash of their ids, about a quarter of the root of their number and PIVOTS at most."""
    n = vectors.count()
    most = max(1, min(PIVOTS, int(n**0.5) // 4))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = vectors.where(place < int(min(1.0, 4 * most / max(n, 1)) * (1 << 30))) if n > 4 * most else vectors
    held: dict[int, list] = {}
    for k, r in enumerate(some.orderBy(place, "id").limit(most).select("vector").collect()):
        held.setdefault(len(r.vector), []).append((k, r.vector))
    return {m: (np.array([k for k, _ in own]), _sphere(np.array([v for _, v in own], np.float64), metric)) for m, own in held.items() if m}


def _assigned(pivots, metric: str):
    """(id, group, vector) -> with cell and distance to its pivot. Without a pivot of its length, and zero for cosine: a cell of no pivot."""

    def run(it):
        for batch in it:
            cell, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for n, rows, x in _by_length(batch.column(2)):
                cell[rows] = -n
                if n in pivots:
                    x = _sphere(x, metric)
                    real = np.flatnonzero((x != 0).any(1)) if metric == "cosine" else np.arange(len(x))
                    far = _distances(x[real], pivots[n][1])
                    best = far.argmin(1)
                    cell[rows[real]], away[rows[real]] = pivots[n][0][best], far[np.arange(len(real)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["id", "group", "vector", "cell", "away"])

    return run


def _reached(pivots, metric: str):
    """(query_id, group, vector) -> the cells it may visit and the distances to their pivots; null for a zero vector and cosine, which no cell is far from."""

    def run(it):
        for batch in it:
            cells, far = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for n, rows, x in _by_length(batch.column(2)):
                x = _sphere(x, metric)
                names, d = (pivots[n][0].tolist(), _distances(x, pivots[n][1])) if n in pivots else ([], np.zeros((len(x), 0)))
                for i, own, v in zip(rows, d, x, strict=True):
                    cells[i] = [*names, -n]
                    far[i] = [None] * (len(names) + 1) if metric == "cosine" and not v.any() else [*own.tolist(), None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.float64()))], names=["query_id", "group", "cells", "far"])

    return run


def _met(k: int | None, metric: str, floor: float | None):
    """(group, cell, part, ask, id, query_id, vector, far, reach), vectors of a part before its questions -> what is found there."""

    def found(ids, x, away, asked: pa.RecordBatch):
        far, reach = (asked.column(c).to_numpy(zero_copy_only=False) for c in (7, 8))
        q = np.stack(asked.column(6).to_numpy(zero_copy_only=False)).astype(np.float64)
        a = 0 if np.isnan(far).any() else int(np.searchsorted(away, (far - reach).min(), "left"))
        b = len(away) if np.isnan(far).any() else int(np.searchsorted(away, (far + reach).max(), "right"))
        if a >= b:
            return
        low, names = _low(q, x[a:b], metric), ids.slice(a, b - a)
        if k is None:
            who, what = np.nonzero(low <= -floor)
        else:
            most = min(k, b - a)
            limit = np.partition(low, most - 1, axis=1)[:, most - 1]
            who, what = np.nonzero(low <= limit[:, None])
            order = np.lexsort((np.array(names.take(pa.array(what)).to_pylist()), low[who, what], who))
            who, what = who[order], what[order]
            first = np.searchsorted(who, np.arange(len(q)))
            kept = np.arange(len(who)) - first[who] < k
            who, what = who[kept], what[kept]
        yield pa.RecordBatch.from_arrays([asked.column(5).take(pa.array(who)), names.take(pa.array(what)), pa.array(low[who, what])], names=["query_id", "id", "low"])

    def run(it):
        key, held, ready = None, [], None
        for batch in it:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if keys[a][:3] != key:
                    key, held, ready = keys[a][:3], [], None
                if not keys[a][3]:
                    held.append(part.select([4, 6, 7]))
                    continue
                if not held:
                    continue
                if ready is None:
                    own = pa.Table.from_batches(held).combine_chunks().sort_by("far")
                    x = np.stack(own.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64)
                    ready = own.column("id").combine_chunks(), x, own.column("far").to_numpy()
                for at in range(0, b - a, AT_ONCE):
                    yield from found(*ready, part.slice(at, AT_ONCE))

    return run


class _Cells:
    """Vectors in their cells, and the questions' ways to them."""

    def __init__(self, queries: DataFrame, vectors: DataFrame, metric: str, by: str | None):
        group = F.coalesce(F.col(by).cast("string"), F.lit("\x00")) if by else F.lit("")
        self.metric, self.kinds = metric, (queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())
        self.queries = materialised(queries.where("size(vector) > 0").select("query_id", group.alias("group"), F.col("vector").cast("array<double>").alias("vector")))
        own = vectors.where("size(vector) > 0").select("id", group.alias("group"), F.col("vector").cast("array<double>").alias("vector"))
        pivots = _chosen(own, metric)
        self.vectors = materialised(own.mapInArrow(_assigned(pivots, metric), f"id {self.kinds[1]}, group string, vector array<double>, cell long, away double"))
        sizes = self.vectors.groupBy("group", "cell").agg(F.count("*").alias("n"), F.max("away").alias("outer"), F.min("away").alias("inner"))
        self.sizes = materialised(sizes.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
        ways = self.queries.mapInArrow(_reached(pivots, metric), f"query_id {self.kinds[0]}, group string, cells array<long>, far array<double>")
        ways = ways.select("query_id", "group", F.explode(F.arrays_zip("cells", "far")).alias("w")).select("query_id", "group", F.col("w.cells").alias("cell"), F.col("w.far").alias("far"))
        self.ways = ways.join(sized(self.sizes), ["group", "cell"])

    def nearest_first(self, k: int) -> DataFrame:
        """The ways with ``first``: the nearest cells of each question that hold k vectors."""
        before = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("far").asc_nulls_first(), "cell").rowsBetween(Window.unboundedPreceding, -1))
        return self.ways.withColumn("first", F.coalesce(before, F.lit(0)) < k)

    def within(self, ways: DataFrame) -> DataFrame:
        """Those of ``ways(..., far, reach)`` whose cells can hold a vector within reach."""
        return ways.where("far is null or (far - outer <= reach and inner - far <= reach)")

    def score(self, ways: DataFrame, k: int | None, floor: float | None = None) -> DataFrame:
        """(query_id, id, low) of the vectors that the ``ways(query_id, group, cell, parts, far, reach)`` lead to: each part's k best, or all up to ``floor``."""
        ways = materialised(ways.select("query_id", "group", "cell", "parts", "far", "reach"))
        visited = sized(ways.select("group", "cell", "parts").distinct())
        rows = self.vectors.join(visited, ["group", "cell"]).select("group", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("ask"), "id", F.lit(None).cast(self.kinds[0]).alias("query_id"), "vector", F.col("away").alias("far"), F.lit(None).cast("double").alias("reach"))
        asks = ways.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(self.queries.select("query_id", "vector"), "query_id")
        rows = rows.union(asks.select("group", "cell", "part", F.lit(True), F.lit(None).cast(self.kinds[1]), "query_id", "vector", "far", "reach"))
        rows = rows.repartition("group", "cell", "part").sortWithinPartitions("group", "cell", "part", "ask")
        return rows.mapInArrow(_met(k, self.metric, floor), f"query_id {self.kinds[0]}, id {self.kinds[1]}, low double")


def _reach(low, metric: str):
    """The distance that a rounded value ``low`` stands for, and a little more."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * (low + 1e-6))) + 1e-6 if metric == "cosine" else low * (1 + 1e-9) + 2e-6


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", by: str | None = None) -> DataFrame:
    """(query_id, id, score, rnk): for each of ``queries(query_id, vector)`` its k nearest of ``vectors(id, vector)``.

    Score is cosine (descending) or l2 (ascending), rounded to six digits; ties go to the smaller id. Vectors
    of another length than the query's, empty ones and nulls are left out; k < 1 gives nothing. With ``by``,
    a column of both sides, only vectors of the query's group compete.
    """
    spark, cells = vectors.sparkSession, _Cells(queries, vectors, metric, by) if k > 0 else None
    if cells is None:
        kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rnk int")
    ways = materialised(cells.nearest_first(k))
    order = Window.partitionBy("query_id").orderBy("low", "id")
    top = lambda df: df.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    seen = materialised(top(cells.score(ways.where("first").withColumn("reach", F.lit(float("inf"))), k)))
    limit = seen.where(F.col("rnk") == k).select("query_id", _reach(F.col("low"), metric).alias("reach"))
    rest = ways.where("not first").join(sized(limit), "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    found = top(seen.drop("rnk").union(cells.score(cells.within(rest), k)))
    return found.select("query_id", "id", ((-F.col("low") if metric == "cosine" else F.col("low")) + 0.0).alias("score"), "rnk")


def within(queries: DataFrame, vectors: DataFrame, floor: float, by: str | None = None) -> DataFrame:
    """(query_id, id, score): for each of ``queries(query_id, vector)`` all of ``vectors(id, vector)`` whose cosine reaches ``floor``.

    Rounding, groups and what is left out as in ``nearest``.
    """
    cells = _Cells(queries, vectors, "cosine", by)
    ways = cells.ways.withColumn("reach", _reach(F.lit(-float(floor)), "cosine"))
    return cells.score(cells.within(ways), None, floor).select("query_id", "id", (-F.col("low") + 0.0).alias("score"))
