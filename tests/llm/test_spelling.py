"""Spelling variants against plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lorebase.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(LETTERS.upper(), LETTERS))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    form, near = {}, {}
    for w in n:
        close = [v for v in n if one_edit(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return sorted(out)


def vocabulary(seed, size=250, letters="abc", long=(6, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*long))): rng.choice([5, 6, 30, 31, 200, 2000]) for _ in range(size)}


def test_automaton_numbers_its_words():
    words = sorted(vocabulary(1, 400))
    automaton = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.walk(0, 0, w, 0)
        assert automaton.final[state] and number == k
    ends = {tuple(sorted((w[i:] for w in words if w.startswith(p)))) for p in {w[:i] for w in words for i in range(len(w) + 1)} for i in [len(p)]}
    reached, stack = {0}, [0]
    while stack:
        for to, _ in automaton.edges[stack.pop()].values():
            if to not in reached:
                reached.add(to)
                stack.append(to)
    assert len(reached) == len(ends)  # one state for each set of ways to end: minimal
    for w in words[:80] + ["aaaaaa", "", "abcabcabcabc"]:
        for exact in (0, len(w) // 2, len(w)):
            found = automaton.one_error(w, exact)
            want = [k for k, v in enumerate(words) if one_edit(w, v) and v[:exact] == w[:exact]]
            assert sorted(found) == want  # each once


def test_groups_against_all_pairs(spark):
    n = vocabulary(2) | vocabulary(3, 60, "abäÿ", (6, 14)) | {"a" * 6: 5, "a" * 7: 30, "a" * 8: 200, "a" * 9: 2000}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute(n)
    assert sum(x[1] is not None for x in want) > 30 and any(x[1] not in (None, x[2]) for x in want)
    for shard in (spelling.SHARD, 20):  # with 20, halves are split
        assert sorted(tuple(r) for r in spelling.grouped(df, shard=shard).collect()) == want


def test_whole_texts(spark):
    rng = random.Random(4)
    words = sorted(vocabulary(5, 120, "abcde", (4, 8)))
    docs = [(k, " ".join(rng.choice([w, w, w.upper(), w[1:] + "Ä"]) + rng.choice(["", ",", "1x", "Ā"]) for w in rng.choices(words, k=300))) for k in range(40)]
    docs += [(40, None), (41, ""), (None, "Gabelung " * 6), (42, "×÷" * 500_000), (43, ("bacbad" + "x" * 30 + " ") * 20_000)] + docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("Half", F.lit(None).cast("string"))
    got = sorted(tuple(r) for r in spelling.spelling(df).collect())
    assert got == brute(brute_counts(docs))
    hit = [(d, w) for d, t in docs for w in re.findall("[a-z]{7,}", (t or "")[:100_000]) if zlib.crc32(f"{d}:{w}".encode()) % 199 == 0]
    assert hit  # some runs do lose a letter
    assert spelling.spelling(df.limit(0)).collect() == []
