import hashlib
import random

from lorebase.llm import fingerprint as P
from pyspark.sql import functions as F


def brute_next(rows):
    """Rows have distinct doc_ids; None comes last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    return out


def made():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghé\U0001f600", k=rng.randrange(2, 9))) for _ in range(800)]
    rows = [(i * 7, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 5, 6, 40, 200, 900])))) for i in range(60)]
    return rows + [(1000, None), (-3, ""), (None, "alone in the dark of the night"), (1007, rows[5][1])]


def test_edits_and_order(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as mark", "2 as n", "3 as part", "4 as sketch").repartition(3)
    got = {r.doc_id: r for r in P.fingerprint(docs).collect()}
    want = brute_next(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    assert got[1007].fingerprint == got[35].fingerprint
    assert got[1000].fingerprint == got[-3].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    long = [r for r in got.values() if r.n_chars > 3000]
    assert long and all(0.5 < r.near_edited <= 1 and r.near_next < 0.1 for r in long)


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def hashes(spark, texts):
    """Of all shingles of ``texts``: its hash."""
    each = sorted({x for t in texts for x in shingles(t)})
    by = {}
    for size in {len(x) for x in each}:
        some = spark.createDataFrame([x for x in each if len(x) == size], [f"c{k}" for k in range(size)])
        row = [F.col(f"c{k}") if k < size else F.lit(None).cast("string") for k in range(P.SHINGLE)]
        by |= {tuple(r[:size]): r[size] for r in some.select("*", F.xxhash64(*row)).collect()}
    return by


def test_sketches_and_likeness_against_sets(spark):
    rows = sorted(made(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    edited = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited[i] = (t, t[: len(t) - len(t) // 3] + nxt[: len(t) // 3], nxt)
    by = hashes(spark, [t for x in edited.values() for t in x])
    sketch = lambda t: {by[x] for x in shingles(t) if by[x] < P._EDGE}
    like = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else float(a == b)
    text = lambda s: ",".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(s))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in P.fingerprint(docs).collect():
        a, b, c = map(sketch, edited[r.doc_id])
        assert (r.fingerprint, r.edited_fingerprint) == (text(a), text(b))
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12


def test_estimates_and_merging(spark):
    a, b = " ".join(map(str, range(4000))), " ".join(map(str, range(3000, 3600)))
    pair = P.with_sketch(P.with_sketch(spark.createDataFrame([(a, b), (a, "no such words are in here"), ("", ""), ("", a)], "a string, b string"), "a", "x"), "b", "y")
    got = pair.select("a", "b", "x", "y", P.likeness(pair.x, pair.y).alias("like"), P.merged(pair.x, pair.y).alias("both")).collect()
    assert [r.like for r in got] == [1.0, 0.0, 1.0, 0.0]
    assert abs(len(got[0].x) / len(shingles(a)) - P.FRACTION) < 0.03
    by = hashes(spark, [a, b, got[1].b])
    for r in got:
        want = shingles(r.a) | shingles(r.b)
        assert r.both == sorted(by[x] for x in want if by[x] < P._EDGE)


def test_a_very_long_text(spark):
    long = " ".join(str(i * i % 100_003) for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long[:600_000])], "doc_id long, text string")
    got = {r.doc_id: r for r in P.fingerprint(docs).collect()}
    assert got[1].n_chars == len(long) and got[2].near_next > 0.99 and got[1].near_edited > 0.6


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (1, "abcdef"), (2, "xyz"), (1, "other")], "doc_id long, text string")
    got = sorted(map(tuple, P.fingerprint(docs).select("doc_id", "n_chars").collect()))
    assert got == [(1, 5), (1, 6), (1, 6), (2, 3)]
    one = P.fingerprint(docs.where("doc_id = 2")).first()
    assert one.edited_sha256 == hashlib.sha256(b"xyx").hexdigest() and one.near_next == 1.0
    assert P.fingerprint(docs.limit(0)).count() == 0
