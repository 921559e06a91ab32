import hashlib
import random
import re

from lorebase.llm import common
from lorebase.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            b = split(t)
            if item is None or not b:
                continue
            k = min(10, len(b))
            for s in {tuple(b[j : j + k]) for j in range(len(b) - k + 1)}:
                for p in range(len(w) - k + 1):
                    if tuple(w[p : p + k]) == s:
                        hit.update(range(p, p + k))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["Ab", "É", "éa", "x1", "the", "OF", "zed", "ü-b", "q"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randrange(12, 30))) for i in range(12)] + [(10, "ab É the x1"), (50, "zed"), (51, "the the the the the the"), (52, None), (53, "..."), (None, "OF OF OF"), (54, text(10))]
    docs = [(i, text(rng.randrange(0, 30)) + " " + rng.choice(items[:12])[1] + ", " + text(5)) for i in range(40)]
    docs += [(60, None), (61, ""), (62, "ZED!"), (None, items[0][1]), (5, "the " * 9), (5, "the " * 9), (5, items[3][1]), (63, "İ K \U0001f600 x1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "2 as h", "3 as window", "4 as n").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as size")
    assert sorted(map(tuple, D.decontaminate(d, b).collect()), key=str) == brute(docs, items)
    common.BROADCAST_ROWS, held = 0, common.BROADCAST_ROWS
    try:
        assert sorted(map(tuple, D.decontaminate(d, b).collect()), key=str) == brute(docs, items)
    finally:
        common.BROADCAST_ROWS = held
    assert sorted(map(tuple, D.decontaminate(d, b.limit(0)).collect()), key=str) == brute(docs, [])
    assert D.decontaminate(d.limit(0), b).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i * i % 9973}" for i in range(150_000)]
    words[120_000:120_000] = [f"item{k}" for k in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "item3 " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"item{k}" for k in range(12)))], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in D.decontaminate(docs, items).collect())
    assert got == [(1, 150_012, 12, 1), (2, 20, 0, 0)]
    assert [r.doc_id for r in D.clean(docs, items).collect()] == [2]
