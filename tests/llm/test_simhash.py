import random

import xxhash

from lorebase.llm import common
from lorebase.llm import simhash as S


def brute(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    fp = {i: brute(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for x in ids:
        for y in ids:
            if x < y and bin(fp[x] ^ fp[y]).count("1") <= 4:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["Alpha", "bé", "Été", "gamma", "delta", "x", "of", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(120)]
    base = " ".join(rng.choices(words, k=300))
    for i in range(120, 180):
        w = base.split(" ")
        w[rng.randrange(300)] = rng.choice(words)
        rows.append((i, "\t".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "The THE the the the"), (204, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "'k' as key")
    want = components(rows)
    for dense in (S.DENSE, 3):
        monkeypatch.setattr(S, "DENSE", dense)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()}
        assert got == want


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, "zz yy")], "doc_id long, text string")
    got = sorted(map(tuple, S.simhash_components(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert S.simhash_components(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i * i % 7919}" for i in range(150_000)]
    want = brute(" ".join(words))
    docs = spark.createDataFrame([(2, " ".join(words)), (1, "\t".join(words).upper()), (3, "other words of a short text")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()}
    assert got[2] == got[1] == (f"{want:016x}", 1) and got[3][1] == 3


def test_components_of_many_tasks_and_of_one(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for a, b in edges * 60:
        root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(edges, "a long, b long")
    want = sorted((x, r) for x, r in root.items() if x != r)
    assert sorted(map(tuple, common.connected_components(table).collect())) == want
    monkeypatch.setattr(common, "TASK_EDGES", 30)
    assert sorted(map(tuple, common.connected_components(table).collect())) == want
