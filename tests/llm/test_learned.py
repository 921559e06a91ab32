import random
import re
import time
import zlib

import numpy as np
import zstandard

from lorebase.llm import language, toxicity


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] > 0.3)).astype(float)
    model = toxicity.Boosted(trees=20).fit(x[:2000], y[:2000])
    model.calibrate(model.margin(x[:2000]), y[:2000])
    p = model.probability(x[2000:])
    assert ((p > 0.5) == (y[2000:] > 0)).mean() > 0.97
    order = np.argsort(model.margin(x[2000:]), kind="stable")
    assert (np.diff(p[order]) >= -1e-12).all() and p.min() >= 0 and p.max() <= 1
    fit = toxicity.Boosted().calibrate(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert fit.levels.tolist() == [0.0, 0.5, 1.0]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefghijk", k=rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words, bad = rng.choices(vocab, k=rng.randrange(20, 120)), int(rng.random() < 0.3)
        for _ in range(4 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "lump", "idiot", "zankapfel"]))
        rows.append((i, " ".join(words)))
        labels.append((i, bad))
    rows += [(2000, None), (2001, ""), (None, "lump lump"), (2002, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as part", "3 as score")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and not got[None].held_out
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    kept = {r.doc_id for r in toxicity.clean(docs, marks).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.0}


def test_language_on_held_out_rows(spark):
    rng = random.Random(7)
    speech = {k: ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(150)] for k, letters in (("aa", "abcdefgh"), ("bb", "hijklmnñ"), ("cc", "aeioußzé"))}
    rows = [(i, " ".join(rng.choices(speech[k := rng.choice("aabbb") * 2 if i % 5 else "cc"], k=rng.randrange(3, 200))), k) for i in range(600)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (None, rows[1][1], None), (1003, rows[0][1] * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as k", "2 as score")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows)
    held = [(i, k) for i, t, k in rows[:600] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].lang_pred == k for i, k in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred == rows[0][2] and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_near_hits_of_a_long_text():
    rng = random.Random(9)
    low = rng.choices(["idiot", "you"] + ["calm"] * 60, k=20_000)
    at, second = [i for i, w in enumerate(low) if w == "idiot"], [i for i, w in enumerate(low) if w == "you"]
    want = sum(any(abs(i - j) <= 5 for j in second) for i in at)
    assert len(at) * len(second) > 10_000 and 0 < want < len(at)
    assert toxicity.features(" ".join(low), {"idiot": 1.0}, {})[toxicity.NAMES.index("near")] == want / len(low)
    assert toxicity._near([], second) == toxicity._near(at, []) == 0 and toxicity._near([0, 6, 20], [5, 26]) == 2


def test_features_of_long_unbroken_texts():
    began = time.time()
    for text in ("a" * 1_000_000, "a1" * 500_000, "a.b" * 300_000, "é!" * 400_000, "a@@" * 300_000):
        assert len(toxicity.features(text, {"a": 1.0}, {})) == len(toxicity.NAMES)
    assert time.time() - began < 30


def test_masked_words_are_those_of_the_plain_pattern():
    plain, rng = re.compile(r"[^\W\d_]+(?:[0-9@$!*][^\W\d_]+)+|\b[^\W\d_](?:[.\-_*][^\W\d_]){2,}\b"), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices("abé1@.-_* !", k=rng.randrange(30)))
        assert toxicity.MASKED.findall(text) == plain.findall(text), text


def test_language_of_long_rows_only(spark):
    """A language whose rows are all long is learned too, and a sample's pieces are bounded."""
    rows = [(i, "uno dos tres " * 900 if i % 2 else "ein zwei drei", "es" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, "dos tres uno dos tres uno dos " * 5, None), (101, "drei ein zwei drei " * 6, None)], "doc_id long, text string, lang string")
    assert {len(v) <= language.DICTIONARY_BYTES + 8 for v in language.learn(docs).values()} == {True}
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert got[100] == "es" and got[101] == "de"


def test_prediction_is_the_least_of_plain_compressions(spark):
    """The query's rows against compressing by hand with the dictionaries of the query."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["la", "casa", "roja", "es"] if i % 2 else ["das", "haus", "ist", "rot"], k=rng.randrange(5, 700))), "es" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned, got = language.learn(docs), {r.doc_id: r for r in language.identify(docs).collect()}
    for i, text, _ in rows:
        size = {}
        for lang, data in learned.items():
            packer = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
            raw = text.encode()
            size[lang] = sum(len(packer.compress(raw[k : k + language.SEGMENT_BYTES])) for k in range(0, len(raw), language.SEGMENT_BYTES))
        assert size[got[i].lang_pred] <= min(size.values()) + 2


def test_sample_counts_texts_sharing_an_id_once(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.toxic) for r in toxicity.sampled(docs, labels).collect())
    assert len(got) == len({i for i, _ in got}) and set(got) <= {(1, 1), (2, 0)}
