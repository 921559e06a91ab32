"""The stored index and its searches against counting by hand."""

import random
import re
import time
import unicodedata
from collections import Counter
from math import log
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import fulltext as X
from lorebase.operators import retrieval as R
from lorebase.session import shared_folder
from lorebase.sources.snapshots import Store


def tokens(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def brute(docs, asked, k, prefix=False, groups=None):
    """docs: id -> text; asked: (query, unit, group) rows -> the rows of a search."""
    toks = {d: tokens(t) for d, t in docs.items()}
    n, mean = len(docs), sum(map(len, toks.values())) / max(len(docs), 1) or 1.0

    def times(ts, unit):
        if prefix:
            return sum(t.startswith(unit) for t in ts)
        words = unit.split(" ")
        return sum(ts[i : i + len(words)] == words for i in range(len(ts)))

    scores: dict = {}
    for (query, unit, group), often in Counter(asked).items():
        f = {d: x for d, ts in toks.items() if (x := times(ts, unit))}
        idf = log((n - len(f) + 0.5) / (len(f) + 0.5))
        for d, x in f.items():
            if groups is None or groups[d] == group:
                part = often * (idf if idf > 0 else 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(toks[d]) / mean))
                scores.setdefault(query, Counter())[d] += part
    out = []
    for query, found in scores.items():
        best = sorted(((-round(v, 6), d) for d, v in found.items()))[:k]
        out += [(query, d, -v, i) for i, (v, d) in enumerate(best, 1)]
    return sorted(out)



def close(found, want):
    found = sorted((r.query_id, r.rnk, r.doc_id, r.score) for r in found.collect())
    want = sorted((q, i, d, s) for q, d, s, i in want)
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(found, want, strict=True))


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["tea", "té", "teapot", "milk", "x", "honey", "ant"] + [f"w{k}" for k in range(150)]
    docs = {d: " ".join(rng.choices(words, [30, 5, 3, 10, 8, 2, 1] + [1] * 150, k=rng.randrange(60))) + rng.choice(["", "/", " green-tea x.y", " Green Tea"]) for d in range(n)}
    return docs | {n: None, n + 1: "", n + 2: "tea " * 5000}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = corpus(1)
    store = Store(spark, f"file://{tmp_path_factory.mktemp('fts')}/s")
    X.build(store, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), per_block=16)
    return docs, store


ASKED = [(1, "tea", "a"), (1, "green tea", "a"), (1, "w3", "a"), (2, "x y", "b"), (2, "tea", "b"), (2, "tea", "b"), (3, "nothing", "a"), (4, "tea tea", "b"), (5, "w1", "c"), (5, "w2", "c"), (6, "", "a")]


def frame(spark, asked, kinds="query_id long, unit string, group string"):
    return spark.createDataFrame(asked, kinds)


@pytest.mark.parametrize(("prune", "k"), [(1, 3), (1000, 20)])
def test_units_and_phrases(spark, built, prune, k):
    docs, store = built
    close(X.search(store.snapshot(), frame(spark, ASKED), k, prune_from=prune), brute(docs, [a for a in ASKED if a[1]], k))


def test_prefixes(spark, built, prune=1):
    docs, store = built
    asked = [(1, "te", "a"), (1, "w1", "a"), (2, "t", "a"), (2, "zz", "a"), (3, "gre", "b")]
    close(X.search(store.snapshot(), frame(spark, asked), 5, prefix=True, prune_from=prune), brute(docs, asked, 5, prefix=True))


def test_scope(spark, built, prune=1000):
    docs, store = built
    groups = {d: "abc"[d % 3] for d in docs}
    scope = frame(spark, list(groups.items()), "doc_id long, group string")
    close(X.search(store.snapshot(), frame(spark, ASKED), 4, scope=scope, prune_from=prune), brute(docs, [a for a in ASKED if a[1]], 4, groups=groups))


def test_statistics(spark, built):
    docs, store = built
    seen = {d: Counter(tokens(t)) for d, t in docs.items()}
    want = sorted((w, sum(w in c for c in seen.values()), sum(c[w] for c in seen.values())) for w in set().union(*seen.values()))
    assert sorted(map(tuple, X.statistics(store.snapshot()).collect())) == want


def test_only_asked_folders_are_read(spark, built):
    _, store = built
    plan = X._units_of(store.snapshot(), spark.createDataFrame([("honey",), ("w3",)], "unit string"), False)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ (IN|INSET) ", plan)
    reads = X.statistics(store.snapshot())._jdf.queryExecution().toString()
    assert "pos:" not in reads.split("ReadSchema")[1] and "docs:" not in reads.split("ReadSchema")[1]


def test_refresh_makes_only_touched_blocks_anew(spark, tmp_path):
    docs = corpus(2, 120)
    table = lambda ds: spark.createDataFrame(list(ds.items()), "doc_id long, text string")
    store, fresh = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    X.build(store, table(docs), per_block=8)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    now = {d: t for d, t in docs.items() if d not in (3, 50)} | {7: "green tea anew", 900: "w3 honey"}
    X.refresh(store, table(now), spark.createDataFrame([(3,), (50,), (7,), (900,)], "doc_id long"))
    X.build(fresh, table(now), per_block=8)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    for _ in range(2):
        close(X.search(store.snapshot(), frame(spark, ASKED), 10), brute(now, [a for a in ASKED if a[1]], 10))
        assert sorted(map(tuple, X.statistics(store.snapshot()).collect())) == sorted(map(tuple, X.statistics(fresh.snapshot()).collect()))
        assert {r.n for r in store.read("members").select(F.sum(F.size("docs")).alias("n")).collect()} == {len(now)}
        for t in ("postings", "members"):
            store.compact(t)
    X.refresh(store, table(now).limit(0), table(now).select("doc_id"))
    assert X.statistics(store.snapshot()).count() == 0 and X.search(store.snapshot(), frame(spark, ASKED), 10).count() == 0


def test_a_posting_travels_once_for_all_its_prefixes():
    """Two rows of terms, three of units: documents are summed up where the block's postings meet."""
    kind = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())), ("len", pa.list_(pa.int32())), ("units", pa.list_(pa.string()))])
    one, two = [pa.RecordBatch.from_pylist(x, kind) for x in ([{"block": 3, "docs": [7, 9], "tf": [2, 1], "len": [10, 5], "units": ["t", "te"]}], [{"block": 3, "docs": [9, 4], "tf": [4, 1], "len": [5, 8], "units": ["t"]}, {"block": 5, "docs": [1], "tf": [1], "len": [2], "units": ["t"]}])]
    rows = sorted((r for b in X._prefixed(iter([one, two])) for r in b.to_pylist()), key=lambda r: (r["block"], r["unit"]))
    assert [(r["unit"], r["block"], r["docs"], r["tf"], r["len"], r["n"], r["max_tf"], r["min_len"]) for r in rows] == [("t", 3, [4, 7, 9], [1, 2, 5], [8, 10, 5], 3, 5, 5), ("te", 3, [7, 9], [2, 1], [10, 5], 2, 2, 5), ("t", 5, [1], [1], [2], 1, 1, 2)]


def test_files_grow_no_larger_with_the_index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    X.build(store, spark.createDataFrame([(k, "tea") for k in range(3 * X.FILE)], "doc_id long, text string"), per_block=1)
    blocks = store.read("postings").groupBy(F.input_file_name()).agg(F.countDistinct("block").alias("n"), F.max("n").alias("docs")).collect()
    assert len(blocks) > 1 and max(r.n for r in blocks) <= X.FILE


def test_a_refresh_of_all_blocks_leaves_nothing_to_hold_against_deletions(spark, tmp_path):
    docs, store = corpus(3, 60), Store(spark, f"file://{tmp_path}/s")
    table = lambda ds: spark.createDataFrame(list(ds.items()), "doc_id long, text string")
    X.build(store, table(docs), per_block=16)
    now = {d: (t or "") + " anew" for d, t in docs.items()}
    X.refresh(store, table(now), table(now).select("doc_id"))
    version = store.snapshot().version
    assert [p.keys for p in store.snapshot().tables["postings"].pieces] == [()] and X.compact(store) == version
    close(X.search(store.snapshot(), frame(spark, [*ASKED, (7, "anew", "a")]), 10), brute(now, [a for a in [*ASKED, (7, "anew", "a")] if a[1]], 10))
    X.refresh(store, table({3: "green tea"}), spark.createDataFrame([(3,)], "doc_id long"))
    assert len(store.snapshot().tables["postings"].pieces) == 3 and X.compact(store) == version + 2
    assert [p.keys for p in store.snapshot().tables["postings"].pieces] == [()]


def test_edges(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    X.build(store, spark.createDataFrame([("b", "Éclair ÑANDÚ"), ("a", "eclair nandu")], "doc_id string, text string"))
    found = X.search(store.snapshot(), spark.createDataFrame([("q", "eclair")], "query_id string, unit string"), 5).collect()
    assert [(r.query_id, r.doc_id, r.rnk) for r in found] == [("q", "a", 1), ("q", "b", 2)]  # ties go to the smaller id
    assert X.search(store.snapshot(), spark.createDataFrame([("q", "eclair")], "query_id string, unit string"), 0).count() == 0
    empty = Store(spark, f"file://{tmp_path}/e")
    X.build(empty, spark.createDataFrame([], "doc_id long, text string"))
    assert X.search(empty.snapshot(), spark.createDataFrame([(1, "x")], "query_id long, unit string"), 5).count() == 0


def test_terms_of_a_search(spark):
    q = spark.createDataFrame([('"Ré-do" tea* tea ?! a(b)\\c',)], "q string")
    assert q.select(T.chunk_units(F.col("q"))).first()[0] == ["re do", "tea", "tea", "a", "b", "c"]
    assert q.select(T.prefix_terms(F.col("q"))).first()[0] == ["re", "do", "tea", "tea", "a", "b", "c"]
    with pytest.raises(Exception, match="empty search"):
        spark.createDataFrame([("?!",)], "q string").select(T.prefix_terms(F.col("q"))).collect()


@pytest.mark.parametrize(("questions", "passes"), [(9, 1), (2, 2)])
def test_each_pass_scores_its_rows_once(spark, built, monkeypatch, questions, passes):
    """Many questions are scored in one pass; few in two, and neither is computed again for a count of its rows."""
    docs, store = built
    seen, made = spark.sparkContext.accumulator(0), X._scored

    def counted(*args):
        def run(it):
            def counting():
                for batch in it:
                    seen.add(batch.num_rows)
                    yield batch

            return made(*args)(counting())

        return run

    monkeypatch.setattr(X, "_scored", counted)
    monkeypatch.setattr(X, "RARE", 1)  # all terms are rare, so that the first pass scores rows
    asked = [(q, unit, "a") for q in range(questions) for unit in ("tea", f"w{q}", "honey")]
    close(X.search(store.snapshot(), frame(spark, asked), 1000, prune_from=1), brute(docs, asked, 1000))
    rows = store.read("postings").where(F.col("term").isin([u for _, u, _ in asked])).count()
    assert 0 < seen.value <= passes * rows


def test_many_terms_of_a_block_are_scored_in_parts(spark, built, monkeypatch):
    docs, store = built
    monkeypatch.setattr(X, "TERMS", 3)
    asked = [(q, f"w{(q * 7 + i) % 150}", "abc"[q % 3]) for q in range(12) for i in range(20)]
    kind = pa.schema([("g", pa.int64()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())), ("len", pa.list_(pa.int32())), ("asking", pa.list_(pa.struct([("query_id", pa.int64()), ("weight", pa.float64()), ("group", pa.string())]))), ("groups", pa.list_(pa.string()))])
    row = lambda d, tf, asks: {"g": 0, "block": 0, "docs": d, "tf": tf, "len": [4] * len(d), "asking": asks, "groups": None}
    rows = [row([k, k + 1], [1, 2], [{"query_id": q, "weight": 1.0, "group": None} for q in range(k % 3 + 1)]) for k in range(10)]
    out = X._scored(4.0, 3, False)(iter([pa.RecordBatch.from_pylist(rows[:4], kind), pa.RecordBatch.from_pylist(rows[4:], kind)]))
    got = {(r["query_id"], r["doc_id"]): r["score"] for b in out for r in b.to_pylist()}
    want: Counter = Counter()
    for r in rows:
        for d, f in zip(r["docs"], r["tf"], strict=True):
            want.update({(a["query_id"], d): f * 2.2 / (f + 1.2) for a in r["asking"]})
    best = {q: sorted((-round(v, 6), d) for (p, d), v in want.items() if p == q)[:3] for q in range(3)}
    assert got == pytest.approx({(q, d): -v for q, b in best.items() for v, d in b})
    groups = {d: "abc"[d % 3] for d in docs}
    close(X.search(store.snapshot(), frame(spark, asked), 4, scope=frame(spark, list(groups.items()), "doc_id long, group string")), brute(docs, asked, 4, groups=groups))


def shuffled(spark):
    """Bytes of shuffle files and of checkpoints that lie there now."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [blocks.apply(i) for i in range(blocks.size())]
    root = shared_folder(spark).removeprefix("file:")
    return sum(f.length() for f in files if f.getName().startswith("shuffle")), sum(p.stat().st_size for p in Path(root).glob("rdd-*/part-*"))


def settled(spark, before):
    """Shuffle files go at the end of a write, but nobody waits for it."""
    for _ in range(50):
        if (now := shuffled(spark))[0] <= before[0]:
            break
        time.sleep(0.1)
    return now


def test_an_index_leaves_nothing_but_its_files(spark, tmp_path):
    """Neither postings nor texts stay shuffled or checkpointed once they are written."""
    docs = spark.createDataFrame(list(corpus(4).items()), "doc_id long, text string")
    store, before = Store(spark, f"file://{tmp_path}/s"), shuffled(spark)
    X.build(store, docs, per_block=16)
    built = settled(spark, before)
    assert built[0] <= before[0] and built[1] == before[1]
    X.refresh(store, docs, docs.select("doc_id"))
    again = settled(spark, built)
    assert again[0] <= built[0] and again[1] - built[1] < 4096  # the touched blocks' numbers


@pytest.mark.parametrize("touched", [(3, 50, 7, 900), None])
def test_blocks_are_made_some_at_a_time(spark, tmp_path, monkeypatch, touched):
    docs, made = corpus(5, 120), []
    table = lambda ds: spark.createDataFrame(list(ds.items()), "doc_id long, text string")
    one = X._made
    monkeypatch.setattr(X, "_made", lambda some, n_blocks, n: made.append((some.count(), n)) or one(some, n_blocks, n))
    monkeypatch.setattr(X, "SLICE", 3)
    store, fresh = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    X.build(store, table(docs), per_block=8)
    assert len(made) == 6 and sum(n for n, _ in made) == len(docs) and max(n for _, n in made) == 3
    assert X.compact(store) == 1  # nothing was deleted
    now = {d: t for d, t in docs.items() if d not in (3, 50)} | {7: "green tea anew", 900: "w3 honey"}
    X.refresh(store, table(now), spark.createDataFrame([(d,) for d in touched or {*docs, *now}], "doc_id long"))
    monkeypatch.undo()
    X.build(fresh, table(now), per_block=8)
    for _ in range(2):
        assert sorted(map(tuple, X.statistics(store.snapshot()).collect())) == sorted(map(tuple, X.statistics(fresh.snapshot()).collect()))
        assert sorted(d for r in store.read("members").collect() for d in r.docs) == sorted(now)
        close(X.search(store.snapshot(), frame(spark, ASKED), 10), brute(now, [a for a in ASKED if a[1]], 10))
        X.compact(store)


def test_units_are_summed_up_before_they_travel(spark, built):
    """Of a batch each unit and block is one row, however many terms it begins."""
    kind = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())), ("len", pa.list_(pa.int32())), ("units", pa.list_(pa.string()))])
    row = lambda block, docs, tf, units: {"block": block, "docs": docs, "tf": tf, "len": [9] * len(docs), "units": units}
    rows = [row(5, [1], [2], ["t"]), row(3, [7, 9], [2, 1], ["t", "te"]), row(5, [1, 2], [1, 1], ["t"]), row(3, [9], [4], ["t"])]
    out = [r for b in X._begun(iter([pa.RecordBatch.from_pylist(rows, kind)])) for r in b.to_pylist()]
    assert sorted((r["block"], r["units"], r["docs"], r["tf"]) for r in out) == [(3, ["t"], [7, 9], [2, 5]), (3, ["te"], [7, 9], [2, 1]), (5, ["t"], [1, 2], [3, 1])]
    docs, store = built
    asked = [(1, u, "a") for u in ("t", "te", "tea", "teap", "teapot", "teapots", "w", "w1", "w10", "hone", "x")]
    close(X.search(store.snapshot(), frame(spark, asked), 9, prefix=True), brute(docs, asked, 9, prefix=True))


def test_postings_are_not_shuffled_to_find_their_prefixes(spark, built, monkeypatch):
    _, store = built
    seen, made = [], X.materialised
    monkeypatch.setattr(R, "BROADCAST_BYTES", 400)  # the units are small, and their terms are not
    monkeypatch.setattr(X, "materialised", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or made(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        X._units_of(store.snapshot(), spark.createDataFrame([("te",), ("w1",), ("hone",)], "unit string"), True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plans = [p for p in seen if "_prefixed" in p]
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and len(re.findall(r"Exchange hashpartitioning\(block", plans[0])) == 1


def test_refreshed_queries_begin_as_the_sessions_index(spark, monkeypatch):
    """It is built once and stays as it is; of the refreshed one only what it replaced is removed."""
    from lorebase.plans import indexing_queries as Q

    sf, builds, one = "/root/testdata/sf0.001/../sf0.001", [], X.build
    monkeypatch.setattr(X, "build", lambda *a: builds.append(a) or one(*a))
    for _ in range(2):
        store = Q.refreshed_index(spark, sf)
    held = Q.index_of(spark, sf)
    assert len(builds) == 1 and held.version == 1 and store.versions() == [2]
    pieces = {p.path.rsplit("/", 1)[-1] for p in store.snapshot().tables["postings"].pieces}
    assert {p.name for p in Path(f"{store.root.removeprefix('file:')}/data/postings").iterdir()} == pieces
    n = lambda s: s.read("members").agg(F.sum(F.size("docs"))).first()[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert n(held) == docs.count() and n(store.snapshot()) == docs.where("doc_id % 11 <> 0").count()
