import random

import numpy as np
import pytest

from lorebase.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


def brute(v, text):
    """Plain Viterbi over the whole text, all pieces tried at each character."""
    if not text:
        return []
    s = P.SPACE + text.replace(" ", P.SPACE)
    ids = {v.pieces[i]: i for i in v.normal}
    most, low = max(map(len, ids)), min(v.scores[i] for i in v.normal) - P.PENALTY
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - most), j):
            k = ids.get(s[i:j])
            if k is not None and best[i][0] + v.scores[k] > best[j][0]:
                best[j] = (best[i][0] + v.scores[k], i, k)
        if best[j - 1][0] + low > best[j][0]:
            best[j] = (best[j - 1][0] + low, j - 1, None)
    out, j = [], len(s)
    while j:
        _, i, k = best[j]
        out = ([k] if k is not None else [v.bytes[b] for b in s[i:j].encode()]) + out
        j = i
    return out


def samples():
    rng = random.Random(8)
    some = ["Hello  world\n x", "   ", "\n\n\t a", "éà ñandú", "\U0001f600\U0001f600 日本語 xyz", "a" * 300, "x\ty  z ", "   lead", "of the and " * 30, "ﷺ̀", "\x00\x01", "▁up"]
    letters = "abcdeéß \n,.日\U0001f600"
    return some + ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(120)]


def test_best_segmentation_and_round_trip(vocabulary):
    t = P.Tokenizer(vocabulary)
    texts = ["", *samples()]
    for text, ids in zip(texts, t.encode(texts), strict=True):
        assert ids.tolist() == brute(vocabulary, text), text
        assert t.decoder.decode(ids.tolist()) == text.replace(P.SPACE, " ")


def test_small_vocabulary_with_ties():
    pieces = ["<unk>", P.SPACE, "a", "b", "ab", "ba", "aba", P.SPACE + "a"]
    v = P.Vocabulary(pieces, [0, -3.0, -2.0, -2.0, -2.0, -2.0, -4.0, -3.0], {0}, 0)
    e = P.Encoder(v)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab ", k=rng.randrange(1, 12)))
        got = [i for u in e.segment(e.units(text)) for i in u.tolist()]
        s, total = P.SPACE + text.replace(" ", P.SPACE), lambda ids: sum(v.scores[i] for i in ids)
        assert "".join(pieces[i] for i in got) == s and got == brute(v, text) and total(got) <= 0
    with pytest.raises(ValueError):
        P.Vocabulary(["a" + P.SPACE], [0.0], set(), 0)


def test_query(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(samples())] + [(None, "x y"), (3, None), (3, ""), (3, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = P.tokenize(docs).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == sorted((i if i is not None else -1, brute(vocabulary, t or "") if t is None or len(t) < 1000 else P.Tokenizer(vocabulary).encode([t])[0].tolist()) for i, t in rows)
    assert P.tokenize(docs.limit(0)).count() == 0
