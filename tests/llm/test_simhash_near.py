import random

import corpus_pipeline
import numpy as np
import pytest
from lorebase.llm import simhash
from lorebase.llm import simhash_near as N


def grams(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def close(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and close(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}


def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghé", k=rng.randrange(2, 9))) for _ in range(2000)]
    out, line = [], rng.choices(vocab, k=30)
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randrange(12, 200))
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + len(w) // 50)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            cut = rng.randrange(0, len(w) // 8 + 1)
            out.append(w[cut:] if rng.random() < 0.5 else w[: len(w) - cut])
    out += [line + rng.choices(vocab, k=rng.randrange(3, 60)) for _ in range(40)]
    out += [line[:k] for k in range(1, 8)]
    long = rng.choices(vocab, k=20_000)
    out += [long, [*long[:9_000], "zz", *long[9_000:]]]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)] + [(900, None), (901, ""), (902, " ")]


@pytest.mark.parametrize("cell, verified", [(N.CELL, N.VERIFIED), (150, 3)])
def test_stage_against_all_pairs(spark, monkeypatch, cell, verified):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "DENSE", verified)
    monkeypatch.setattr(N, "GROUP_PAIRS", 8 * verified)
    monkeypatch.setattr(N, "ROUNDS", 0 if verified == 3 else N.ROUNDS)
    monkeypatch.setattr(N, "VERIFIED", verified)
    table = rows()
    want = kept(table)
    far = [(a, b) for a, s in table for b, t in table if a < b and close(grams(s), grams(t)) and (simhash.simhash(s) ^ simhash.simhash(t)).bit_count() > 4]
    assert len(far) > 50 and len(want) < len(table) - 50
    docs = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "'k' as lang", "1 as mark", "2 as sid")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and len(got) == len(set(got))
    assert want <= set(got) and len(set(got) - want) <= 1


def test_pairs_at_the_threshold_meet():
    """Share of pairs of sets at a similarity of exactly 0.8 that some segment brings together."""
    rng, met, below = np.random.default_rng(4), 0, 0
    for _ in range(400):
        both = rng.integers(-(1 << 62), 1 << 62, 400)
        a, b = (np.unique(np.concatenate([both, rng.integers(-(1 << 62), 1 << 62, 50)])) for _ in range(2))
        assert N.similar(a, b)
        x, y = N.wide_print(a), N.wide_print(b)
        assert np.bitwise_count(x ^ y).sum() <= N.ALL_BITS + 8
        below += np.bitwise_count(x ^ y).sum() <= N.ALL_BITS
        parts = [int(v) >> N.WIDTH * k & (1 << N.WIDTH) - 1 for v in x ^ y for k in range(N.CUTS)]
        met += any(p.bit_count() <= 1 for p in parts) and int(x[0] ^ y[0]).bit_count() <= N.FIRST_BITS
    assert met / 400 >= 0.97 and below / 400 >= 0.99


def test_links_at_exactly_the_threshold_by_size(spark):
    """Pairs of n and 5n/4 shingles, the smaller set within the larger: a similarity of 0.8; short ones are all found."""
    rng, table, sizes = random.Random(3), [], [4, 8, 12, 16, 20, 100, 400]
    for n in sizes:
        for _ in range(60):
            words = [f"x{rng.randrange(10**9)}" for _ in range(n + 4 + n // 4)]
            table += [(len(table), " ".join(words[: n + 4])), (len(table) + 1, " ".join(words))]
    got = {r.doc_id for r in N.representatives(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert set(range(0, len(table), 2)) <= got
    lost = {n: sum(120 * k <= i < 120 * (k + 1) for i in got) - 60 for k, n in enumerate(sizes)}
    assert all(x == 0 if n <= N.SHORT else x <= 3 for n, x in lost.items())


def test_short_sets_sharing_much_are_linked_exactly():
    """Against all pairs, in a group that shares a shingle: what is connected is the same."""
    rng = np.random.default_rng(9)
    sets = [np.unique(np.append(rng.choice(14, rng.integers(3, 12), replace=False), 99)).astype(np.int64) for _ in range(120)]
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            if N.similar(sets[i], sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    own = list(range(120))
    for a, b in N._linked(list(range(120)), sets):
        assert N.similar(sets[a], sets[b])
        own = [own[a] if r == own[b] else r for r in own]
    same = lambda r: {tuple(i for i in range(120) if r[i] == x) for x in set(r)}
    assert same(own) == same(root) and 1 < len(same(root)) < 120


def test_cells_cover_all_pairs():
    rng = np.random.default_rng(5)
    prints = [np.full(60, 7, np.int64) + rng.integers(0, 2, 60) for _ in range(N.WORDS)]
    sid = rng.permutation(60).astype(np.int64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (sid, np.full(60, 9), sid, *prints)], names=["sid", "n", "comp", *N._PRINT])
    found = {}
    for blocks in ({}, dict.fromkeys(range(2 * N.WORDS * N.CUTS << N.HALF), 3)):
        pairs = [(a, b) for got in N._crossed(N._dealer(blocks, True)(iter([batch]))) for a, bs in zip(*(c.to_pylist() for c in got.columns), strict=True) for b in bs]
        found[bool(blocks)] = set(pairs)
    assert found[False] == found[True] == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_repeated_rows(spark):
    table = [(1, "a b c"), (1, "a b c"), (1, "q r s t u v"), (2, "A  b c"), (None, "z z z z"), (None, "z z z z")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(map(tuple, N.representatives(docs).collect()), key=str) == sorted([(1, "a b c"), (1, "q r s t u v"), (None, "z z z z")], key=str)
    assert N.representatives(docs.limit(0)).count() == 0
    other = docs.selectExpr("*", "case when rand(3) < 0.5 then 'x' else 'y' end as _mark", "'r' as `row`", "1 as root")
    got = N.representatives(other)
    assert got.columns == other.columns and got.count() == 3
