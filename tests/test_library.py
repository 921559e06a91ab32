import pytest
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.operators import library as L


def test_schemas(spark):
    assert len(schemas.DDL) == 23
    assert schemas.schema("vectors_t1")["embedding"].dataType.simpleString() == "array<float>"
    assert schemas.schema("books")["author"].nullable and not schemas.schema("books")["id"].nullable
    assert all(c in schemas.schema(t).names for t, c in (*schemas.ALLOWED, *schemas.DEFAULTS))


def test_rows_meet_their_schema(spark):
    rows = spark.sql("select 1 id, 's' study_id, 'goal' kind, 'c' content, 'user' source, cast(null as double) confidence, timestamp_ntz'2024-01-01' created_at, timestamp_ntz'2024-01-01' updated_at, 9 extra")
    got = schemas.conform(rows, "memory_facts").first()
    assert (got.confidence, got.status) == (0.7, "active") and list(got.asDict()) == schemas.schema("memory_facts").names
    with pytest.raises(Exception, match="memory_facts.content is missing"):
        schemas.conform(rows.drop("content"), "memory_facts").collect()
    with pytest.raises(Exception, match="memory_facts.status must be one of"):
        schemas.conform(rows.withColumn("status", F.lit("odd")), "memory_facts").collect()
    studies = spark.createDataFrame([("s",), ("s",)], "slug string")
    assert schemas.conform(rows, "memory_facts", {"study_id": studies}).count() == 1
    with pytest.raises(Exception, match="study_id has no parent: s"):
        schemas.conform(rows, "memory_facts", {"study_id": studies.limit(0)}).collect()


def test_names_and_fallbacks(spark):
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "g long, name string")
    taken = spark.createDataFrame([(1, "a"), (1, "a (2)"), (1, "a (4)"), (2, "a (2)")], "g long, name string")
    assert sorted((r.g, r.name, r.free) for r in L.free_names(wanted, taken, "g", "name").collect()) == [(1, "a", "a (3)"), (1, "b", "b"), (2, "a", "a")]
    full = spark.createDataFrame([(1, "a")] + [(1, f"a ({k})") for k in range(2, 1000)], "g long, name string")
    with pytest.raises(Exception, match="no free name"):
        L.free_names(wanted.limit(1), full, "g", "name").collect()
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    of = lambda *rows: spark.createDataFrame(list(rows), "query_id long, context string")
    got = {r.query_id: (r.kind, r.context) for r in L.fallback(asked, [("hybrid", of((1, "h"), (2, " "))), ("file", of((1, "f"), (2, "f")))]).collect()}
    assert got == {1: ("hybrid", "h"), 2: ("file", "f"), 3: ("none", None)}


def test_fences(spark):
    df = spark.createDataFrame([(["a", "x\n```", "code", "``` y", "z"],), (["```", "open"],), ([],), (["in `` ``` line", "b", " ~~~", "c", "~~~"],)], "p array<string>")
    assert [r[0] for r in df.select(L.healed_fences(df.p)).collect()] == [["a", "x\n```\ncode\n``` y", "z"], ["```\nopen"], [], ["in `` ``` line", "b", " ~~~\nc\n~~~"]]
    assert df.limit(1).select(L.healed_fences(df.p, 8)).first()[0] == ["a", "x\n```\ncode", "``` y\nz"]


def test_snippets(spark):
    df = spark.createDataFrame([("a b Tea, d e",), ("no hit at all",), ("",)], "t string")
    terms = F.array(F.lit("tea"))
    assert [r[0] for r in df.select(L.snippet(df.t, terms, 2)).collect()] == ["…<<Tea,>> d…", "no hit…", ""]
    two = spark.createDataFrame([("tea x y z tea tea x",)], "t string")
    assert two.select(L.snippet(two.t, terms, 3)).first()[0] == "…<<tea>> <<tea>> x"


@pytest.mark.parametrize("scores,ids,want", [([0.1, 0.6], [1, 2], 2), ([0.1], [1, 2], None), ([0.6, 0.7], [1], 1), ([], [], None)])
def test_first_passing(spark, scores, ids, want):
    df = spark.createDataFrame([(scores, ids)], "s array<double>, i array<bigint>")
    assert df.select(L.first_passing(df.s, df.i)).first()[0] == want


def test_routed(spark):
    df = spark.createDataFrame([("Rewrite: a b\nClass: keyword", "q"), ("nothing", "why so blue"), (None, "TCP x")], "a string, q string")
    rewrite, kind = L.routed(df.a, df.q)
    assert [tuple(r) for r in df.select(rewrite, kind).collect()] == [("a b", "keyword"), ("why so blue", "conceptual"), ("TCP x", "keyword")]


def test_similar_pairs_of_a_large_group(spark):
    turns = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "turn_id long, vector array<float>")
    chunks = spark.createDataFrame([(i, [1.0, 0.0] if i < 120 else [3.0, 4.0]) for i in range(130)] + [(200, None), (201, [1.0])], "chunk_id long, vector array<float>")
    got = sorted(map(tuple, L.similar_pairs(turns, chunks, 0.8).collect()))
    assert got == [(1, i, 1.0) for i in range(120)] + [(2, i, 0.8) for i in range(120, 130)]
    assert L.similar_pairs(turns.limit(0), chunks).count() == 0
