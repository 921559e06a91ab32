import struct

import pytest
from pyspark.sql import functions as F
from lorebase.functions import text as T
from lorebase.functions import vectors as V
from lorebase.operators import activity as A
from lorebase.operators import graph as G
from lorebase.operators import neighbours as N
from lorebase.operators import retrieval as R
from lorebase.plans import plugins as P

RANK = "query_id long, doc_id long, rnk int"


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], RANK)
    f = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], RANK)
    assert [r.doc_id for r in R.fuse(v, f).orderBy("rnk").collect()] == [20, 10, 30]
    assert [r.doc_id for r in R.fuse(v, f.limit(0)).orderBy("rnk").collect()] == [10, 20]
    assert R.fuse(v.limit(0), f.limit(0)).count() == 0
    w = spark.createDataFrame([(1, 0.1, 2.0)], "query_id long, w_vec double, w_fts double")
    assert [r.doc_id for r in R.fuse(v, f, w).orderBy("rnk").collect()] == [20, 30, 10]


def chain(spark, text="t"):
    rows = [(1, "b", 0, "one", 5), (2, "b", 0, "two", 300), (3, "b", 0, "three", 300), (4, "b", 1, "four", 900), (5, "b", 1, "five", 700), (6, "b", 1, "six", 700)]
    return spark.createDataFrame(rows, "doc_id long, source string, section_no long, text string, token_count long")


def test_windows_and_merging(spark):
    texts = chain(spark)
    c = R.with_links(texts.drop("text"))
    hits = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.25, 2), (1, 5, 0.2, 3), (1, 6, 0.1, 4), (2, 2, 0.5, 1)], "query_id long, doc_id long, score double, rnk int")
    got = {(r.query_id, r.doc_id): r.window_text for r in R.sentence_window(hits.select("query_id", "doc_id"), c, texts).collect()}
    assert got[(1, 2)] == "one\n\ntwo\n\nthree" and got[(1, 3)] == "two\n\nthree"
    merged = sorted((r.query_id, r.doc_id, r.score, r.source_chunks, r.pos) for r in R.merge_parents(hits, c).collect())
    assert merged == [(1, 1, 0.75, [2, 3], 1), (1, 5, 0.2, [5], 3), (1, 6, 0.1, [6], 4), (2, 2, 0.5, [2], 1)]


def test_packing_stops(spark):
    rows = spark.createDataFrame([(1, 10, 1, 50), (1, 11, 2, 100), (1, 12, 3, 1), (2, 13, 1, 999)], "query_id long, doc_id long, rnk int, token_count long")
    got = {r.doc_id: (r.used_tokens, r.marker) for r in R.pack(rows, 150, 20).collect()}
    assert got == {10: (70, 1)}


@pytest.mark.parametrize("balance,want", [(1.0, [1, 2, 3]), (0.0, [1, 3, 2]), (0.5, [1, 2, 3]), (0.4, [1, 3, 2])])
def test_diversity(spark, balance, want):
    q = [1.0, 0.0]
    rows = [(1, 1, 0.9, [1.0, 0.0], q), (1, 2, 0.8, [0.99, 0.05], q), (1, 3, 0.1, [0.2, 0.9], q)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, relevance double, vector array<float>, query_vector array<float>")
    assert [r.doc_id for r in R.diverse(df, 3, balance).orderBy("pick").collect()] == want
    assert R.diverse(df, 0, balance).count() == 0 and R.diverse(df, 9, balance).count() == 3


def test_missing_vectors_use_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.03, None, [1.0]), (1, 2, 0.05, None, [1.0])], "query_id long, doc_id long, relevance double, vector array<float>, query_vector array<float>")
    assert [r.doc_id for r in R.diverse(df, 2).orderBy("pick").collect()] == [2, 1]


def test_sides_are_broadcast_by_rows_and_bytes(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame([(1, "x" * 100, [1.0] * 10)] * 5, "id long, t string, v array<float>")
    assert "ResolvedHint" in plan(R.sized(df)) or R.sized(df) is not df
    assert R.sized(df, 4) is df
    monkeypatch.setattr(R, "BROADCAST_BYTES", 300)
    assert R.sized(df) is df


def test_nearest_of_a_group_and_bytes(spark):
    v = spark.createDataFrame([(i, "ab"[i % 2], [float(i), 1.0]) for i in range(1500)], "id long, book string, vector array<float>")
    q = v.where("id in (10, 701)").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rnk): (r.id, r.score) for r in N.nearest(q, v, 3, "l2", by="book").collect()}
    assert got == {(10, 1): (10, 0.0), (10, 2): (8, 2.0), (10, 3): (12, 2.0), (701, 1): (701, 0.0), (701, 2): (699, 2.0), (701, 3): (703, 2.0)}
    values = [0.0, -0.0, 1.0, -2.5, 3.14159274, 1e-45, -7e20, float("inf")]
    one = spark.createDataFrame([(values, bytearray(struct.pack("<8f", *values))), (None, None), ([1.0], bytearray(b"abc"))], "v array<float>, b binary")
    rows = one.select(V.from_bytes(F.col("b"), 8), V.to_bytes(F.col("v"))).collect()
    assert list(rows[1]) == [None, None] and rows[2][0] is None
    assert rows[0][0] == list(struct.unpack("<8f", one.first().b)) and bytes(rows[0][1]) == bytes(one.first().b)


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.id, r.score) for r in N.nearest(q, v, 3).orderBy("rnk").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert [(r.id, r.score) for r in N.nearest(q, v, 2, "l2").orderBy("rnk").collect()] == [(1, 0.0), (3, 0.0)]
    assert N.nearest(q, v, 0).count() == 0 and N.nearest(q.limit(0), v, 3).count() == 0
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0, 9.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(V.cosine(df.a, df.b)).collect()] == [1.0, 0.0]
    assert [r[0] for r in df.select(V.mean(df.a, df.b)).collect()] == [[1.5, 3.0], [0.5]]


def test_entities_and_graph(spark):
    docs = spark.createDataFrame([(1, "학교에서 학교는 것이라고 the Tree_1 tree_1 42 x"), (2, "tree_1 water"), (3, "tree_1 water"), (4, "tree_1")], "doc_id long, text string")
    e = G.entities(docs)
    assert [(r.entity, r.weight) for r in e.where("doc_id = 1").orderBy("rnk").collect()] == [("tree_1", 2), ("학교", 2), ("것이", 1)]
    books = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "doc_id long, book string")
    hits = spark.createDataFrame([(9, 2, 0.5)], "query_id long, doc_id long, score double")
    near = G.expand(hits, e.join(books, "doc_id"))
    assert [(r.doc_id, r.strength) for r in near.orderBy("rnk").collect()] == [(1, 2), (3, 2)]
    grown = {r.doc_id: r.score for r in G.append(hits, near).collect()}
    assert grown == {2: 0.5, 1: 0.45, 3: 0.45}


def test_boilerplate(spark):
    rows = [(1, i, f"Header line\nThis is one sentence.\nbody {i}") for i in range(3)] + [(2, 9, "Header line")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, text string")
    assert [(r.query_id, r.line) for r in R.boilerplate(df).collect()] == [(1, "Header line")]
    got = {(r.query_id, r.doc_id): r.text for r in R.clean_passages(df).collect()}
    assert got[(1, 0)] == "This is one sentence.\nbody 0" and got[(2, 9)] == "Header line"


def test_gates_on_empty_tables(spark):
    empty = spark.createDataFrame([], "status string, method string, citation double, outcome string, ts long, id long, rating double")
    row = A.gates(empty, empty, empty, empty).first()
    assert (row.active_ratio, row.card_ratio, row.dismissed, row.attempted_ratio, row.rating_mean) == (None, None, 0, None, None)


def test_checks_and_conflicts(spark):
    df = spark.createDataFrame([("a",), ("z",)], "kind string")
    with pytest.raises(Exception, match="kind must be one of"):
        A.checked(df, "kind", ("a", "b")).collect()
    p = spark.createDataFrame([(1, 1, "green tea now"), (2, 2, "green")], "study long, id long, text string")
    c = spark.createDataFrame([(1, 5, "no tea and green")], "study long, id long, text string")
    assert [tuple(r) for r in A.conflicts(p, c).collect()] == [(1, 1, 5, "green")]


def test_plugins(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    got = [r[0] for r in df.select(P.embedded(df.t, lambda: P.hash_embedder(8))).collect()]
    assert got[0] == got[1] and len(got[0]) == 8 and sum(got[2]) == 0
    df = spark.createDataFrame([("q", 'Rewrite: "better"'), ("q", ""), ("q", None)], "q string, a string")
    assert [r[0] for r in df.select(P.rewritten(df.q, df.a)).collect()] == ["better", "q", "q"]
    assert spark.range(1).select(P.reranked(F.lit("abcdefg"), F.lit("xabcdefgx"))).first()[0] == 0.6
