"""Nearest neighbours by cells against comparing with all, and what the bounds leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.operators import neighbours as N


def cloud(seed, n=700, dim=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 10, (12, dim))
    x = middle[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, dim))
    x[: n // 3] = x[0]  # a third of all are one vector
    x[n // 2] = 0
    return x.astype(np.float32)


def brute(q, x, k, metric, groups=None):
    low = N._low(q.astype(float), x.astype(float), metric)
    out = []
    for i, row in enumerate(low):
        own = [j for j in range(len(x)) if groups is None or groups[0][i] == groups[1][j]]
        best = sorted((row[j], j) for j in own)[:k]
        out += [(i, j, -v + 0.0 if metric == "cosine" else v + 0.0, r) for r, (v, j) in enumerate(best, 1)]
    return out


def frames(spark, q, x, groups=None):
    g = groups or (["a"] * len(q), ["a"] * len(x))
    queries = spark.createDataFrame([(i, b, v.tolist()) for i, (b, v) in enumerate(zip(g[0], q, strict=True))], "query_id long, book string, vector array<float>")
    return queries, spark.createDataFrame([(i, b, v.tolist()) for i, (b, v) in enumerate(zip(g[1], x, strict=True))], "id long, book string, vector array<float>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("part", [N.PART, 50])
def test_against_all(spark, monkeypatch, metric, part):
    monkeypatch.setattr(N, "PART", part)
    x = cloud(1)
    q = np.concatenate([x[::97], cloud(2)[300:310], np.zeros((1, 3), np.float32)])
    got = [tuple(r) for r in N.nearest(*frames(spark, q, x), 7, metric).orderBy("query_id", "rnk").collect()]
    assert got == brute(q, x, 7, metric)


def test_groups(spark):
    x, q = cloud(3, 400), cloud(3, 400)[::50]
    groups = (["a", "b"] * 4, ["ab"[i % 3 == 0] for i in range(400)])
    got = [tuple(r) for r in N.nearest(*frames(spark, q, x, groups), 5, "l2", by="book").orderBy("query_id", "rnk").collect()]
    assert got == brute(q, x, 5, "l2", groups)
    few = N.nearest(*frames(spark, q, x[:1], (groups[0], ["a"])), 5, "l2", by="book").collect()
    assert {(r.query_id, r.id, r.rnk) for r in few} == {(i, 0, 1) for i in range(0, 8, 2)}


def test_all_from_a_floor_on(spark):
    x = cloud(4, 300)
    q = x[::60]
    got = sorted((r.query_id, r.id, r.score) for r in N.within(*frames(spark, q, x), 0.9).collect())
    low = N._low(q.astype(float), x.astype(float), "cosine")
    assert got == sorted((int(i), int(j), float(-low[i, j] + 0.0)) for i, j in zip(*np.nonzero(low <= -0.9), strict=True))


def test_lengths_nulls_and_none(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", None), ("d", []), ("e", [2.0])], "id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0]), ("r", None), ("s", [1.0, 1.0, 1.0])], "query_id string, vector array<float>")
    assert [(r.query_id, r.id, r.score) for r in N.nearest(q, v, 5, "l2").orderBy("rnk").collect()] == [("q", "b", 0.0), ("q", "e", 1.0)]
    assert N.nearest(q, v, 0).count() == 0 and N.nearest(q.limit(0), v, 3).count() == 0 and N.nearest(q, v.limit(0), 3).count() == 0


def test_cells_out_of_reach_are_not_scored(spark, monkeypatch):
    """Far clusters: after the first cells a question visits few others, and no driver loop or list of questions is there."""
    x = cloud(5, 3000)
    visited = []
    real = N._Cells.score
    monkeypatch.setattr(N._Cells, "score", lambda self, ways, *a, **k: (visited.append(ways.select("query_id", "cell").collect()), real(self, ways, *a, **k))[1])
    q = x[1500:1520]
    cells = N._Cells(*frames(spark, q, x), "l2", None)
    every = cells.ways.count()
    N.nearest(*frames(spark, q, x), 3, "l2").collect()
    assert len(visited) == 2 and sum(map(len, visited)) < every / 2
    assert cells.sizes.agg(F.sum("n")).first()[0] == 3000


def test_no_question_goes_through_the_driver():
    import inspect

    assert "toLocalIterator" not in inspect.getsource(N) and inspect.getsource(N).count(".collect()") == 1  # the pivots
