import random
import re
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import chunking
from lorebase.operators import learning as L
from lorebase.operators import triggers as G


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_routes(spark):
    cases = {"`x` why how": "keyword", 'what is "it" then': "keyword", "why is the sky blue": "conceptual", "왜 그런가 설명": "conceptual", "TCP handshake": "keyword", "why": "balanced", "one two three four TCP": "balanced", "open main.rs now": "keyword", "the end.": "balanced", "": "balanced", "a::b": "keyword", "snake_case": "keyword"}
    assert run(spark, T.route, list(cases)) == list(cases.values())


def test_page_lines_and_cleaning(spark):
    yes = ["42", "- 42 -", "— 7 —", "p. 42", "p42", "Page 42", "42 페이지", "42쪽", "- 12 페이지 -", "· 3 ·", "면 3"]
    no = ["12345", "chapter 4", "p", "page", "4 apples", "", "- -"]
    assert run(spark, T.is_page_line, yes) == [True] * len(yes)
    assert run(spark, T.is_page_line, no) == [False] * len(no)
    cases = {"a\x00b\t c   d": "ab c d", "one\n42\ntwo": "one\ntwo", "a\n\n\n\nb": "a\n\nb", "exam-\nple and in-\n a-\nb": "example and inab", "X-\nY 3-\nz": "X-\nY 3-\nz", "\f\n x \n": "x", "": ""}
    assert run(spark, T.clean_passage, list(cases)) == list(cases.values())


def test_terms_and_keys(spark):
    assert run(spark, T.phrase_terms, ['a "b c" (d*)', "", ":^-"]) == [["a", "b", "c", "d"], [], ["-"]]
    assert run(spark, T.query_key, ["B a  b!", "A, B", ""]) == ["a b", "a b", ""]
    assert run(spark, T.token_estimate, ["", "a", "x" * 100, "é" * 101]) == [0, 1, 30, 31]
    assert run(spark, T.significant, ["active tea x 지적 ab"]) == [["tea", "ab"]]
    assert run(spark, T.fold_diacritics, ["éàñ"]) == ["ean"]


def test_slugs_and_chapters(spark):
    assert run(spark, T.slug, [" A b/c! ", "???", "한글 제목"]) == ["§A-b-c", "§untitled", "§한글-제목"]
    assert run(spark, T.chapter_number, ["Chapter 3: x", "ch. 12", "ch7", "제 4 장", "5장", "6", "seven", "3 apples"]) == [3, 12, 7, 4, 5, 6, None, None]
    assert run(spark, T.chapter_slug, [3, 12, 120], "int") == ["Ch03", "Ch12", "Ch120"]


def test_followups_and_self_reports(spark):
    assert run(spark, T.is_followup, ["왜?", "x", "그러면 다음은", "a plain question", "어디 있는지 아주 길게 묻는 말"]) == [True, False, True, False, False]
    assert run(spark, T.self_reports, ["I KNOW this, easy", "no"]) == [["i know", "easy"], []]
    df = spark.createDataFrame([(0.9, 0.2), (0.5, 0.4), (None, 0.1)], "c double, p double")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(T.progress_gap_severity(df.c, df.p)).collect()] == [1.0, None, None]
    df = spark.createDataFrame([("easy", 0.4), ("easy", None), ("easy", 0.5), ("hard", 0.0)], "t string, c double")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(T.self_report_severity(df.t, df.c)).collect()] == [0.5, 0.9, None, None]


def test_names_and_misc(spark):
    assert run(spark, T.valid_name, ["ok", " a", "b.", "a/b", "con", "CON.txt", "x" * 201, "한글", ""]) == [True, False, False, False, False, False, False, True, False]
    assert run(spark, T.json_object, ['x {"a": {"b": 1}} y', "none"]) == ['{"a": {"b": 1}}', None]
    assert run(spark, lambda c: T.unquoted_line(c, "rewrite"), ['Rewrite: "a b"\nmore', " \n", "plain"]) == ["a b", None, "plain"]
    assert run(spark, lambda c: T.truncate_lines(c, 7), ["abc\ndef\nghi", "short"]) == ["abc\n…", "short"]
    assert run(spark, lambda c: T.title_of(c, 5), ["a\nb", "123456"]) == ["a b", "12345…"]
    df = spark.createDataFrame([(2, 64), (8, 8), (8, 16), (8, 32), (8, 4)], "c int, r int")
    assert [r[0] for r in df.select(T.hardware_tier(df.c, df.r)).collect()] == ["minimum", "t1", "t2", "t2_reranker", "minimum"]
    assert run(spark, T.pause_priority, ["user", "chat", "?"]) == [4, 0, None]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "Alpha beta gamma [S1]. Nothing alike here [S2]! And [S9]. Again alpha [S1]."), (2, "none"), (3, "짧은 말 [S1]。")], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1, "we say alpha beta gamma too: Alpha beta"), (1, 2, "zzz"), (3, 1, "짧은 말 [S1]")], "answer_id long, marker long, text string")
    got = {(r.answer_id, r.marker): (r.score, r.verdict) for r in L.verdicts(answers, sources).collect()}
    assert got == {(1, 1): (0.6, "pass"), (1, 2): (0.0, "no_match"), (3, 1): (0.0, "no_match")}
    df = spark.createDataFrame([("abc", "xabcx"), ("abc", "x"), ("abcdef", "zabcdefz"), ("", "x")], "a string, s string")
    assert [r[0] for r in df.select(T.answer_in_source(df.a, df.s)).collect()] == [0.6, 0.0, 0.6, 0.0]


@pytest.mark.parametrize("state,q,want", [((2.5, 0, 0), 5, (2.6, 1, 1)), ((2.5, 1, 1), 4, (2.5, 6, 2)), ((2.5, 6, 2), 4, (2.5, 15, 3)), ((2.5, 10, 4), 2, (2.18, 1, 0)), ((1.3, 1, 3), 0, (1.3, 1, 0)), ((1.3, 1, 2), 3, (1.3, 2, 3))])
def test_sm2(state, q, want):
    ef, interval, reps = L.sm2(*state, q)
    assert (round(ef, 6), interval, reps) == want


def test_triggers_and_violations(spark):
    texts = ["이제부터 짧게 답해. 농담 빼줘", "이제부터 짧게 답해.\n농담 빼줘", None, "그러지 마", "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(G.triggers(F.col("t"))).collect()]
    assert [[(h.kind, h.entry) for h in hits] for hits in got] == [[("preference", "짧게 답해")], [("preference", "짧게 답해"), ("correction", "농담")], [], [("correction", "그러지 마")], []]
    corrections = spark.createDataFrame([(1, 1, "- (active, 2회) 농담 하지 말아줘"), (1, 2, "- (resolved) 반말 하지 마"), (2, 3, "- (active) x")], "study long, correction_id long, item string")
    answers = spark.createDataFrame([(1, 10, "여기 농담 하나"), (1, 11, "반말 아님"), (2, 12, "농담")], "study long, answer_id long, answer string")
    assert [tuple(r) for r in G.violations(answers, corrections).collect()] == [(1, 10, 1, "농담")]
    hits = spark.createDataFrame([(1, "goal", "read")], "turn_id long, kind string, entry string")
    similar = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.5), (2, 7, 0.86)], "turn_id long, chunk_id long, similarity double")
    assert sorted((r.turn_id, r.kind, r.confidence, r.chunks) for r in G.confirmed(hits, similar).collect()) == [(1, "goal", 0.9, [5]), (2, "meta", 0.86, [7])]


#: What the cues stand for, written as whole patterns.
PATTERNS = (
    ("preference", r"(?m)(?:^|\s)이제부터\s+(.+?)(?:[.,!?]|$)"),
    ("preference", r"(?m)(?:^|\s)앞으로(?:는)?\s+(.+?)(?:[.,!?]|$)"),
    ("preference", r"(?m)(.+?)\s*스타일로\s+(?:가자|해줘|부탁)"),
    ("correction", r"(?m)(.+?)\s*하지\s*말아?\s*줘"),
    ("correction", r"(?m)그러지\s*마"),
    ("correction", r"(?m)(.+?)\s*빼줘"),
    ("goal", r"(?m)(.+?)(?:까지|을|를)\s*(?:끝내고\s*싶|목표야|마치고\s*싶)"),
)


def test_triggers_against_whole_patterns():
    rng, hits = random.Random(3), 0
    parts = ["이제부터 ", "앞으로는 ", "앞으로 ", "스타일로 해줘", "하지 말아 줘", "그러지 마", "빼줘", "까지 끝내고 싶", "을 목표야", "a", "b c", ". ", "!", "\n", " ", "글"]
    for _ in range(3000):
        text, free, want = "".join(rng.choices(parts, k=rng.randrange(1, 9))), [], []
        for kind, pattern in PATTERNS:
            for m in re.finditer(pattern, text):
                if all(m.end() <= a or m.start() >= b for a, b in free):
                    free.append(m.span())
                    if (m[1] if m.re.groups else m[0]).strip():
                        want.append((kind, (m[1] if m.re.groups else m[0]).strip()))
        got = [(kind, entry) for kind, _, entry in G.detect(pd.Series([text]))[0]]
        hits += len(want)
        assert got == want, text
    assert hits > 1000
    began = time.time()
    assert len(G.detect(pd.Series(["글" * 200_000 + " 빼줘", "이제부터 " * 40_000]))) == 2 and time.time() - began < 10


def test_texts_of_a_batch_are_cut_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3 * chunking.AT_ONCE + 1)), "text": ["ab"] * (3 * chunking.AT_ONCE + 1)})
    out = list(chunking._cutting(lambda t: [(0, t[:1]), (1, t[1:])])([batch]))
    assert [b.num_rows for b in out] == [2 * chunking.AT_ONCE] * 3 + [2]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [x for k in range(len(batch)) for x in ((k, 0, 0, "a"), (k, 1, 1, "b"))]
