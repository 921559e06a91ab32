import hashlib
import random

import numpy as np
import pytest

from lorebase.llm import suffixes as S


def brute(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            first[raw[s : s + 50]] = min(first.get(raw[s : s + 50], S.NO_ID + 1), S.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < (S.NO_ID if i is None else i):
                gone[s : s + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randrange(1, 9)))
    vocab = [word() for _ in range(60)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passages = [text(30) for _ in range(4)]
    rows = [(i, text(rng.randrange(0, 60)) + rng.choice(passages) + text(rng.randrange(0, 40))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "z" * 300), (103, "z" * 120), (104, None), (105, ""), (106, "q" * 49), (107, "q" * 50), (108, "q" * 50), (None, passages[0]), (None, passages[0] + "x"), (-5, passages[1])]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lo", "'x' as key", "2 as bin").repartition(3)
    got = sorted(map(tuple, S.remove_repeats(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("share", [0, 3, 9000])
def test_small_chunks_and_many_bins(share):
    rows = made(9) + [(40, "same id"), (41, made(9)[5][1]), (41, "other text " * 9), (41, "other text " * 9)]
    cut, spans = S.CHUNK_BYTES, []
    S.CHUNK_BYTES = 400
    try:
        import pandas as pd
        import pyarrow as pa

        raws = [(t or "").encode() for _, t in rows]
        common = S.common_cells(raws)
        grams = S.frequent_grams(raws, share, common)
        assert (len(grams) > 0) == (share == 9000) or share == 3
        batch = pa.RecordBatch.from_arrays([pa.array([S.NO_ID if i is None else i for i, _ in rows]), pa.array([hash(t) % 9999 for _, t in rows]), pa.array([(t or "").encode() for _, t in rows], pa.binary())], names=["doc_id", "variant", "raw"])
        dealt = pd.concat([b.to_pandas() for b in S._cutter(7, grams, common)([batch.slice(0, 20), batch.slice(20)])])
        spans = pd.concat([S._binned(b'')(g) for _, g in dealt.groupby("bin")])
    finally:
        S.CHUNK_BYTES = cut
    want = {(r[0], r[1], r[2]) for r in brute(rows)}
    got = set()
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        mine = spans[(spans.doc_id == (S.NO_ID if i is None else i)) & (spans.variant == hash(t) % 9999)]
        for lo, hi in zip(mine.lo, mine.hi, strict=True):
            gone[lo:hi] = True
        got.add((i, len(raw), int(gone.sum())))
    assert got == want


def test_repeated_ids_and_empty(spark):
    text = "the same fifty byte string is here in all of the rows, " * 2
    rows = [(1, text), (1, text), (1, text + "more"), (2, text), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.remove_repeats(docs).collect()), key=str) == brute(rows)
    assert S.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [2, 3, 26])
def test_groups_are_the_equal_windows(letters):
    rng = np.random.default_rng(letters)
    part = rng.integers(97, 97 + letters, 400, np.uint8)
    near = part.copy()
    near[45::60] ^= 1  # windows that agree in their first bytes only
    buf = np.concatenate([part, near, part[:200], np.full(300, 97, np.uint8), part])
    at = np.arange(len(buf) - S.DEPTH + 1)
    got, group = S._equal_groups(S._words(buf), at)
    found, want = {}, {}
    for p, g in zip(got.tolist(), group.tolist(), strict=True):
        found.setdefault(g, set()).add(p)
    for p in at.tolist():
        want.setdefault(buf[p : p + 50].tobytes(), set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)


def test_bins_in_turns_and_a_long_text(spark, monkeypatch):
    rng = np.random.default_rng(2)
    buf = np.concatenate([rng.integers(97, 100, 700, np.uint8)] * 3)
    at, doc = np.arange(len(buf) - S.DEPTH + 1), np.arange(len(buf) - S.DEPTH + 1) // 700
    whole = S._bin_later(buf, at, doc)
    monkeypatch.setattr(S, "MOST_BYTES", 100)
    assert len(whole) and S._bin_later(buf, at, doc).tolist() == whole.tolist()
    monkeypatch.undo()
    long = "".join(map(chr, rng.integers(97, 123, 2_500_000)))
    docs = spark.createDataFrame([(1, long[1_000_000:1_000_200]), (2, long), (3, long[-300:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.remove_repeats(docs).collect()}
    assert got == {1: (0, 0), 2: (200, 1), 3: (300, 1)}
