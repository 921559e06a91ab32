import re

import pytest
from pyspark.sql import functions as F

from lorebase.operators import activity as A
from lorebase.operators import indexing as I
from lorebase.plans import plugins as P
from lorebase.plans import retrieval_queries as Q
from lorebase.sources import documents as D
from lorebase.sources import stores as S
from lorebase.sources.snapshots import Store


def test_puts(spark):
    cache = spark.createDataFrame([("a", [1.0], 1, 1), ("b", [2.0], 1, 1)], "key string, embedding array<float>, created long, last_hit long")
    new = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "key string, embedding array<float>")
    got = {r.key: (r.embedding, r.created, r.last_hit) for r in I.cache_put(cache, new, F.lit(9), 1).collect()}
    assert got == {"a": ([1.0], 1, 1), "b": ([3.0], 1, 9), "c": ([4.0], 9, 9)}
    with pytest.raises(Exception, match="dimension must be 2: 1"):
        I.cache_put(cache, new, F.lit(9), 2).collect()


def test_embedding_in_batches(spark, tmp_path):
    sizes = []

    class Model:
        def __call__(self, texts):
            if "bad" in texts:
                raise ValueError("bad")
            return [[float(len(t))] * (3 if t == "wide" else 2) for t in texts]

    rows = [(i, "b", f"text {i}", None, 0) for i in range(70)] + [(100, "b", "bad", None, 2), (101, "b", "bad", "failed", 0), (102, "b", " ", None, 0), (103, "b", "wide", None, 0), (104, "b", "x", "done", 0), (105, "c", "known", None, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, book string, text string, status string, attempts long")
    cache = spark.createDataFrame([("known", [7.0, 7.0])], "t string, embedding array<float>").select(I.T.embedding_key(F.col("t"), F.lit("m")).alias("key"), "embedding")
    out = I.embed_pending(chunks, cache, Model, "m", 2)
    got = {r.chunk_id: (r.status, r.attempts, r.embedding, r.cached) for r in out.collect()}
    assert 104 not in got and all(got[i] == ("done", 0, [float(len(f"text {i}"))] * 2, False) for i in range(70))
    assert got[100] == ("failed", 3, None, False) and got[101][:2] == got[102][:2] == got[103][:2] == (None, 1)
    assert got[105] == ("done", 1, [7.0, 7.0], True)
    assert {r.book: (r.chunks, r.done, r.failed, r.pending, r.cached) for r in I.progress(out).collect()} == {"b": (74, 70, 1, 3, 0), "c": (1, 1, 0, 0, 1)}
    assert sizes == []


def test_batches_commit_vectors_status_and_progress_together(spark, tmp_path, monkeypatch):
    kind = "chunk_id long, book string, embedding array<float>, status string, attempts long, cached boolean"
    batch = lambda *rows: spark.createDataFrame(list(rows), kind)
    store = Store(spark, f"file://{tmp_path}/s")
    read = lambda name, *c: sorted(map(tuple, store.read(name).select(*c).collect()))
    first = batch((1, "a", [1.0], "done", 0, False), (2, "a", None, None, 1, False), (3, "b", [3.0], "done", 0, True))
    assert I.commit(first, store, 0) == I.commit(first, store, 0) == 1  # a replay
    assert I.commit(first.limit(0), store, 1) == 1
    with monkeypatch.context() as m:  # dies before it is published
        m.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            I.commit(batch((2, "a", [2.0], "done", 1, False)), store, 1)
    assert read("vectors", "chunk_id") == [(1,), (3,)] and read("jobs", "book", "done", "pending") == [("a", 1, 1), ("b", 1, 0)]
    assert I.commit(batch((2, "a", [2.0], "done", 1, False), (4, "a", None, "failed", 3, False)), store, 1) == 2
    assert read("vectors", "chunk_id") == [(1,), (2,), (3,)] and read("chunks", "chunk_id", "attempts") == [(1, 0), (2, 1), (3, 0), (4, 3)]
    assert read("jobs", "book", "chunks", "done", "failed", "pending", "cached") == [("a", 3, 2, 1, 0, 0), ("b", 1, 1, 0, 0, 1)]


def test_a_second_tier_is_built_behind_the_first(spark, tmp_path):
    store, cache = Store(spark, f"file://{tmp_path}/s"), spark.createDataFrame([], "key string, embedding array<float>")
    chunks = spark.createDataFrame([(i, "b", f"text {i}") for i in range(6)], "chunk_id long, book string, text string")
    build = lambda tier, dim, rows=chunks, most=None: I.build_tier(store, tier, rows, cache, lambda: P.hash_embedder(dim), tier, dim, most)
    width = lambda rows=chunks: {len(r.embedding) for r in I.tier_vectors(store.snapshot(), rows, "t1", "t2").collect()}
    build("t1", 2)
    for n in (2, 4):
        build("t2", 4, most=2)
        assert store.read("t2").count() == n and width() == {2}
    build("t2", 4, most=2)
    assert width() == {4} and store.read("t2").count() == 6
    fewer = chunks.where("chunk_id <> 3").union(spark.createDataFrame([(9, "b", "new")], chunks.schema))
    assert width(fewer) == {2}  # a new chunk that the second tier lacks
    build("t2", 4, fewer)
    assert width(fewer) == {4} and {r.chunk_id for r in store.read("t2").collect()} == {0, 1, 2, 4, 5, 9}


def test_pauses_and_replays(spark):
    e = spark.createDataFrame([(1, 1, 1, "pause", "user"), (1, 2, 2, "pause", "chat"), (1, 3, 3, "resume", "chat"), (1, 4, 4, "resume", "user"), (2, 5, 1, "resume", "chat")], "worker long, id long, ts long, kind string, owner string")
    assert [(r.id, r.running) for r in I.paused(e).orderBy("id").collect()] == [(1, False), (2, False), (3, False), (4, True), (5, True)]
    t = spark.createDataFrame([(1, 0, "delta", "a"), (1, 1, "delta", "b"), (1, 2, "done", None), (2, 0, "delta", "x"), (2, 1, "cancel", None), (2, 2, "delta", "y")], "handle long, seq long, kind string, delta string")
    assert sorted(map(tuple, I.replayed(t).collect())) == [(1, "ab", 2, True), (2, "x", 1, False)]


def test_metacognition_chain(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "this is easy", 0.1, 0.9), (1, 2, "2024-01-01 00:01:00", "x", 0.1, 0.9), (1, 3, "2024-01-01 00:20:00", "i know", 0.2, 0.9), (1, 4, "2024-01-01 00:40:00", "i got it", 0.2, 0.9), (2, 5, "2024-01-01 00:00:00", "fine", None, 0.1)]
    turns = spark.createDataFrame(rows, "study long, id long, ts string, text string, citation double, progress double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    alerts = A.alerts(A.metacog_signals(turns)).dropDuplicates(["id"])
    assert sorted(r.id for r in alerts.collect()) == [1, 2, 3, 4]
    facts = A.alert_facts(A.cooled_alerts(alerts), F.col("combo")).collect()
    assert sorted((r.id, r.confidence, r.kind) for r in facts) == [(1, 0.4, "meta"), (4, 0.4, "meta")]


def test_a_gap_of_just_three_tenths_is_a_signal(spark):
    """0.7 - 0.4 and 0.5 - 0.2 lie on different sides of 0.3 in binary."""
    turns = spark.createDataFrame([("s", k, "2024-01-01 00:00:00", "x", c, p) for k, (c, p) in enumerate([(0.7, 0.4), (0.4, 0.7), (0.5, 0.2), (0.69, 0.4)])], "study string, id int, ts string, text string, citation double, progress double")
    assert sorted(r.id for r in A.metacog_signals(turns).collect()) == [0, 1, 2]


def test_histories(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(16)] + [(2, k, "user", "same") for k in range(5)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: (r.raw, r.older) for r in A.split_history(c).collect()} == {1: (12, "m0 m1 m2 m3"), 2: (5, "")}
    asked = spark.createDataFrame([(1, "m14"), (2, "same")], "conv_id long, question string")
    assert sorted((r.conv_id, r.turn) for r in A.recent(c, 3, asked).collect()) == [(1, 12), (1, 13), (1, 15)]


def test_generation_falls_back(spark):
    df = spark.createDataFrame([("q",), ("boom",), (None,)], "q string")

    def make():
        def model(text):
            if text == "boom":
                raise RuntimeError
            return f'Rewrite: "better {text}"'

        return model

    assert [r[0] for r in df.select(P.rewritten(F.col("q"), P.generated(F.col("q"), make))).collect()] == ["better q", "boom", None]
    assert [r[0] for r in df.select(P.rewritten(F.col("q"), P.generated(F.col("q"), None))).collect()] == ["q", "boom", None]
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    assert first(P.hypothetical(F.lit("q"), F.lit('HyDE: "line one\nline two"'))) == "line one\nline two" and first(P.hypothetical(F.lit("q"), F.lit(" \n"))) == "q"
    assert first(P.summary(F.lit(None), F.lit("x" * 700))) == "x" * 600 + "…" and first(P.summary(F.lit("Summary: s\nmore"), F.lit("x"))) == "s"
    card = '{"question": "q", "options": ["a", "b", "c", "d"], "correct": 2}'
    assert first(P.choice_card(F.lit(f"here: {card} ok"))).correct == 2
    assert [first(P.choice_card(F.lit(x))) for x in ("no", card.replace('"d"', '" "'), card.replace("2", "4"))] == [None] * 3
    assert first(P.titled(F.lit(None), F.lit("a\nb"))) == "a b" and first(P.titled(F.lit('Title: "T"'), F.lit("m"))) == "T"


def test_strengths(spark):
    sf = "/root/testdata/sf0.001"
    fast, balanced = ({r.query_id: r for r in Q.answers(spark, sf, s).collect()} for s in ("fast", "balanced"))
    both = fast.keys() & balanced.keys()  # a first source of more than the budget leaves a question without any
    assert len(both) > 10
    assert all(r.used_tokens <= 4000 for r in [*fast.values(), *balanced.values()])
    blocks = [b for r in fast.values() for b in r.sources_block.split("\n\n[S")]
    assert all(", §" in b.split("\n")[0] for b in blocks)  # each source names its book and section
    books = [set(re.findall(r"\(책: (\w+), §", r.sources_block)) for r in fast.values()]
    assert all(len(b) == 1 for b in books)  # one book a question
    assert any(fast[q].sources_block != balanced[q].sources_block for q in both)
    assert max(r.kept for r in balanced.values()) <= 6 and max(r.kept for r in fast.values()) <= 12
    assert "hyde" in P.STRENGTH["accurate"] and "hyde" not in P.STRENGTH["balanced"]


def test_hypothetical_answers_reach_the_vectors(spark):
    """A model's hypothetical answer changes what is searched by vector and how diversity is judged; the text search keeps the question."""
    sf = "/root/testdata/sf0.001"
    width = len(spark.read.parquet(f"{sf}/embeddings.parquet").first().embedding)
    run = lambda make: {r.query_id: r.sources_block for r in Q.answers(spark, sf, "accurate", make, lambda: P.hash_embedder(width)).collect()}
    plain, guessed = run(None), run(lambda: lambda t: "answer: the and of to " * 9)
    both = plain.keys() & guessed.keys()
    assert len(both) > 10 and any(plain[q] != guessed[q] for q in both)


def test_small_text_functions(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    may = lambda a, b: first(I.T.may_pause(F.lit(a), F.lit(b)))
    assert may("chat", "user") and not may("user", "quit") and not may("user", "user") and may(None, "chat") and not may("chat", None)
    assert [first(I.T.blank_null(F.lit(x))) for x in ("", " \n", "a ")] == [None, None, "a "]
    assert first(I.T.query_prefixed(F.lit("x"), 1)) == "query: x" and first(I.T.passage_prefixed(F.lit("x"), 2)) == "x"
    plan = first(I.T.heading_plan(F.lit("# A #\ntext\n##  B b\n#no\n###\n    # code\n")))
    assert [tuple(r) for r in plan] == [(1, "A"), (2, "B b"), (3, "")]
    sections = D.markdown_sections(spark.createDataFrame([(1, "# A #\n\ntext\n\n##  B b\n\n# C")], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r.level, r.label) for r in sections] == [tuple(r) for r in first(I.T.heading_plan(F.lit("# A #\n\ntext\n\n##  B b\n\n# C")))]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_event_feed(step):
    wire = b": hi\r\nevent: a\r\ndata: one\r\ndata: two\r\n\r\ndata:x\n\nevent: none\n\ndata: tail"
    feed, got = D.EventFeed(), []
    for k in range(0, len(wire), step):
        got += feed.feed(wire[k : k + step])
    assert got == [("a", "one\ntwo"), ("", "x")] and feed.feed(b"!\n\n") == [("", "tail!")]
    with pytest.raises(ValueError, match="no colon"):
        D.EventFeed().feed(b"oops\n\n")


def test_plain_files_and_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("# é")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("x" * (1024 * 1024 + 1))
    (tmp_path / "d.html").write_text("no")
    got = {r.source_path.rsplit("/", 1)[1]: (r.text, r.error) for r in D.plain_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# é", None), "b.txt": (None, "not UTF-8"), "c.txt": (None, "larger than 1 MB")}
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, None), (1, 3, "three")], "doc_id long, page int, text string")
    assert [tuple(r) for r in D.page_texts(pages).collect()] == [(1, ["", "two", "three"])]


def test_versions_and_tiers(spark, tmp_path):
    chunks = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    t1, t2 = str(tmp_path / "t1"), str(tmp_path / "t2")
    S.publish(chunks.withColumn("v", F.lit(1)), t1)
    assert {r.v for r in S.active_tier(spark, chunks, t1, t2).collect()} == {1}
    S.publish(chunks.limit(1).withColumn("v", F.lit(2)), t2)
    assert {r.v for r in S.active_tier(spark, chunks, t1, t2).collect()} == {1}
    S.publish(chunks.withColumn("v", F.lit(2)), t2)
    S.publish(chunks.withColumn("v", F.lit(3)), t2, {"blank": 1})
    assert {r.v for r in S.active_tier(spark, chunks, t1, t2).collect()} == {2}
    place = str(tmp_path / "books")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "book string, x long")
    S.replace_partition(rows, place, "book")
    S.replace_partition(rows.where("book = 'a'").withColumn("x", F.lit(9).cast("long")), place, "book", rows.select("book"))
    assert [tuple(r) for r in spark.read.parquet(place).select("book", "x").collect()] == [("a", 9)]


@pytest.mark.parametrize("meet", [2, 10_000])
def test_conflicts_meet_in_parts_and_no_pair_is_exchanged(spark, meet, monkeypatch):
    monkeypatch.setattr(A, "MEET", meet)
    words = ["alpha", "beta", "since", "gamma", "delta", "alpha", "x1"]
    text = lambda k, n: " ".join(words[(k * k + j * n) % 7] for j in range(k % 5))
    items = lambda n, m: [(None if k == 4 else k % 3, k, None if k == 6 else text(k, m)) for k in range(n)]
    p, c = [*items(40, 1), (1, 7, "x1 gamma beta")], [*items(30, 2), (1, 7, "x1")]  # 7 comes twice
    significant = lambda t: [w for w in (t or "").split() if w != "since"]
    want: dict = {}
    for study, pref, said in p:
        for other, corr, against in c:
            if study is not None and study == other:
                for pos, token in enumerate(significant(said)):
                    if token in significant(against):
                        want[study, pref, corr] = min(want.get((study, pref, corr), (99, "")), (pos, token))
    frame = lambda rows: spark.createDataFrame(rows, "study long, id long, text string")
    found = A.conflicts(frame(p), frame(c))
    rows = found.collect()
    assert len(rows) == len(want) and {(r.study, r.pref_id, r.corr_id): r.token for r in rows} == {k: t for k, (_, t) in want.items()}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_their_text_lies(spark):
    docs = spark.createDataFrame([(("a", 0), "Té te, x_te 7"), (("a", 1), None), (("b", 0), "?!"), (("b", 1), "te")], "doc_id struct<book:string,ord:int>, text string")
    got = I.postings(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id.book, r.doc_id.ord, r.term, r.tf, r.doc_len) for r in got.collect()) == [("a", 0, "7", 1, 5), ("a", 0, "te", 3, 5), ("a", 0, "x", 1, 5), ("b", 1, "te", 1, 1)]
