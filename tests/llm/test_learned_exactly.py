"""What the learned classifiers compute, recomputed plainly: splits and scores of trees, the isotonic map, sizes, margins and ties."""

import math
import random

import numpy as np
import zstandard
from lorebase.llm import language, toxicity


def test_a_tree_splits_where_trying_all_splits_does():
    """Every split against all cuts of all features, by hand; leaves against the formula."""
    rng = np.random.default_rng(3)
    x, g, h = rng.integers(0, 8, (200, 3)), rng.normal(0, 1, 200), rng.uniform(0.1, 0.25, 200)
    g[x[:, 1] > 4] += 1.5

    def value(rows):
        return -sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)

    def gain(rows):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def check(tree, rows, depth):
        tries = []
        if depth and len(rows) >= 10:
            for k in range(3):
                for cut in range(7):
                    left, right = [i for i in rows if x[i, k] <= cut], [i for i in rows if x[i, k] > cut]
                    if len(left) >= 2 and len(right) >= 2:
                        tries.append((gain(left) + gain(right) - gain(rows), k, cut))
        if not isinstance(tree, tuple):
            assert abs(tree - value(rows)) < 1e-9 and max(tries, default=(0,))[0] <= 1e-3 + 1e-9
            return 1
        k, cut, low, high = tree
        mine = next(t for t in tries if t[1:] == (k, cut))
        assert mine[0] >= max(tries)[0] - 1e-9
        return check(low, [i for i in rows if x[i, k] <= cut], depth - 1) + check(high, [i for i in rows if x[i, k] > cut], depth - 1)

    assert check(toxicity._grow(x, g, h, np.arange(200), 3, 8), list(range(200)), 3) >= 4


def test_the_isotonic_map_is_the_best_monotone_fit():
    """Against the max-min formula of isotonic regression, with ties of margins."""
    rng = np.random.default_rng(4)
    margin, y = np.round(rng.normal(0, 1, 120), 1), rng.integers(0, 2, 120).astype(float)
    model = toxicity.Boosted().calibrate(margin, y)
    levels = np.unique(margin)
    mean = lambda a, b: y[(margin >= a) & (margin <= b)].mean()
    for m in levels:
        want = max(min(mean(a, b) for b in levels if b >= m) for a in levels if a <= m)
        k = np.searchsorted(model.knots, m)  # a block's knot is its first or last margin
        assert min(abs(model.levels[j] - want) for j in (k - 1, min(k, len(model.levels) - 1)) if j >= 0) < 1e-9
    assert (np.diff(model.levels) > 0).all()


def test_the_query_scores_each_text_by_its_trees(spark):
    """Scores of the query's rows against features, walks and interpolation by hand; held-out rule and threshold."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(400):
        bad = i % 3 == 0
        words = rng.choices(["idiot", "you", "stupid", "hate"] if bad else ["the", "river", "of", "you", "time"], k=rng.randrange(3, 30))
        rows.append((i, " ".join(words) + ("!" if bad else ".")))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    trees = model.trees

    def score(text):
        x = toxicity.features(text, model.words, model.stems)
        cells = [sum(e < v for e in edges) for v, edges in zip(x, trees.edges, strict=True)]
        margin = trees.base
        for tree in trees.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if cells[tree[0]] <= tree[1] else tree[3]
            margin += trees.rate * tree
        knots, levels = trees.knots.tolist(), trees.levels.tolist()
        if margin <= knots[0] or margin >= knots[-1]:
            return levels[0] if margin <= knots[0] else levels[-1]
        k = max(j for j in range(len(knots)) if knots[j] <= margin)
        return levels[k] + (levels[k + 1] - levels[k]) * (margin - knots[k]) / (knots[k + 1] - knots[k])

    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    for i, text in [*rows, (900, None), (901, "")]:
        assert abs(got[i].score - score(text)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.7)
    assert {got[i].predicted for i in range(400)} == {0, 1}


def test_sizes_scores_and_margins_of_languages(spark):
    """score and rejected from sizes compressed by hand, segment by segment."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["la", "casa", "roja", "es"] if i % 2 else ["das", "haus", "ist", "rot"], k=rng.randrange(1, 900))), "es" if i % 2 else "de") for i in range(60)]
    rows += [(100, "la das", None), (101, "qwxyz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned, got = language.learn(docs), {r.doc_id: r for r in language.identify(docs).collect()}
    packers = {}
    for lang, data in learned.items():
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=language.LEVEL)
        packers[lang] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_content_size=False)
    narrow = set()
    for i, text, _ in rows:
        raw, size = text.lower().encode(), {}
        for lang, packer in packers.items():
            size[lang] = sum(len(packer.compress(raw[k : k + language.SEGMENT_BYTES])) for k in range(0, len(raw), language.SEGMENT_BYTES))
        least, second = sorted(size.values())
        assert size[got[i].lang_pred] == least
        assert abs(got[i].score - 1 / sum(math.exp((least - s) / 3) for s in size.values())) < 1e-12
        assert got[i].rejected == (second - least < max(2, 0.01 * least))
        narrow.add(got[i].rejected)
    assert narrow == {True, False}


def test_ties_go_to_the_language_with_more_rows(spark):
    rows = [(i, "uno dos tres", "zz" if i % 3 else "aa") for i in range(30)] + [(i, "otra cosa es", "bb") for i in range(30, 40)]
    docs = spark.createDataFrame([*rows, (99, "uno dos", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(docs).collect() if r.doc_id == 99} == {"zz"}


def test_letters_are_those_of_unicode(spark):
    texts = ["²", "½ ①", "12 !?", "Ⅻ", "", None, "ª", "字", "a1"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(i, "uno dos tres", "es") for i in range(20, 60)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(len(texts))] == ["und"] * 6 + ["es"] * 3


def test_every_language_is_learned(spark, monkeypatch):
    """Many languages share the sample's bound; none is left out while there are no more of them than rows."""
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 40)
    rows = [(20 * k + i, f"w{k} x{k} y{k}", f"l{k:02d}") for k in range(20) for i in range(20)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(learned) == [f"l{k:02d}" for k in range(20)]
