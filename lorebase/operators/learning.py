"""Study cards, spaced repetition, recall checks and citations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.counting import top_terms

CLOZE, DISTRACTORS, ORDER_LEAST, ORDER_MOST = 3, 3, 3, 5


def _keyword(token: str) -> str | None:
    return None if len(token) < 2 or token in T.KEYWORD_STOPS else token


def keywords(docs: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, term, cnt, rnk): the most frequent tokens of two characters or more, stop words out."""
    return top_terms(docs, F.lower(F.col("text").cast("string")), r"[^\W_]+", _keyword, n, ("term", "cnt", "rnk"))


def recall(expected: DataFrame, answers: DataFrame, passing: float = 0.6) -> DataFrame:
    """(doc_id, n_expected, n_present, passed): how many of a text's keywords an answer has; null ratio fails."""
    lists = expected.groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("expected"))
    both = answers.select("doc_id", T.normal_answer(F.col("answer")).alias("a")).join(lists, "doc_id")
    present = F.filter("expected", lambda k: F.contains(F.col("a"), k))
    return both.select("doc_id", F.size("expected").alias("n_expected"), F.size(present).alias("n_present"), F.array_join(F.array_except("expected", present), ",").alias("missing"), F.coalesce(F.try_divide(F.size(present), F.size("expected")) >= passing, F.lit(False)).alias("passed"))


def cloze(docs: DataFrame) -> DataFrame:
    """(doc_id, n, front, back): up to three words of a text, evenly spaced, each blanked where it first occurs."""
    toks = docs.select("doc_id", "text", T.maskable(F.col("text")).alias("toks"))
    step = F.greatest(F.lit(1), F.floor(F.size("toks") / CLOZE).cast("int"))
    picks = F.slice(F.filter(F.transform("toks", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x.i % step == 0), 1, CLOZE)
    rows = toks.select("doc_id", "text", F.posexplode(picks).alias("n", "pick")).select("doc_id", "text", "n", F.col("pick.t").alias("back"))
    return rows.select("doc_id", "n", F.overlay("text", F.lit("[___]"), F.instr("text", F.col("back")), F.length("back")).alias("front"), "back")


def sourced(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """``cards(doc_id, n, back)`` with the score of each answer against its source ``sources(doc_id, text)``, and whether it is kept."""
    score = T.answer_in_source(F.col("back"), F.col("text"))
    return cards.join(sources.select("doc_id", "text"), "doc_id").select("doc_id", "n", "back", score.alias("score"), (score >= 0.5).alias("kept"))


def label(doc_id: Column, section: Column) -> Column:
    return F.concat(F.lit("청크 #"), doc_id.cast("string"), F.lit(" ("), F.coalesce(T.blank_null(section), F.lit("unknown")), F.lit(")"))


def match(chunks: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, front, back): a chunk's first line and where its successor stands, among three chunks of other sections.

    ``chunks(book, section, doc_id, text)``. Distractors are the chunks of the book with the least
    seeded hash; four a section suffice to leave three outside any one.
    """
    nxt = F.lead("doc_id").over(Window.partitionBy("book", "section").orderBy("doc_id"))
    pairs = chunks.select("book", "section", "doc_id", T.first_line(F.col("text"), 100).alias("line"), nxt.alias("next_id")).where("next_id is not null")
    draw = F.struct(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))).alias("h"), "doc_id", "section")
    per = Window.partitionBy("book", "section").orderBy("d")
    few = chunks.select("book", "section", draw.alias("d")).withColumn("k", F.row_number().over(per)).where(F.col("k") <= DISTRACTORS)
    top = Window.partitionBy("book").orderBy("d")
    few = few.withColumn("k", F.row_number().over(top)).where(F.col("k") <= 2 * DISTRACTORS).groupBy("book").agg(F.array_sort(F.collect_list("d")).alias("pool"))
    both = pairs.where(F.btrim("line") != "").join(few, "book")
    others = F.slice(F.filter("pool", lambda d: d.section != F.col("section")), 1, DISTRACTORS)
    right = label(F.col("next_id"), F.col("section"))
    labels = F.concat(F.array(right), F.transform(others, lambda d: label(d.doc_id, d.section)))
    options = F.array_join(F.transform(labels, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n")
    return both.select("doc_id", F.concat(F.lit('다음 첫 줄은 어느 단락에 속합니까?\n\n"'), F.col("line"), F.lit('"')).alias("front"), F.concat(F.lit("정답: "), right, F.lit("\n\n"), options).alias("back"))


def order(chunks: DataFrame) -> DataFrame:
    """(book, section, doc_id, front, back): the first three to five chunks of a section, first and last swapped."""
    k = F.row_number().over(Window.partitionBy("book", "section").orderBy("doc_id"))
    rows = chunks.select("book", "section", "doc_id", T.first_line(F.col("text"), 80).alias("line")).withColumn("k", k).where(F.col("k") <= ORDER_MOST)
    sets = rows.groupBy("book", "section").agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("c")).where(F.size("c") >= ORDER_LEAST)
    n = F.size("c")
    swapped = F.concat(F.slice("c", n, 1), F.slice("c", F.lit(2), n - 2), F.slice("c", 1, 1))
    shown = F.array_join(F.transform(swapped, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x.line)), "\n")
    letters = F.array_join(F.transform("c", lambda x, i: F.char(F.when(i == 0, n - 1).when(i == n - 1, 0).otherwise(i) + 65)), " → ")
    return sets.select("book", "section", F.col("c")[0].doc_id.alias("doc_id"), F.concat(F.lit("다음 단락들을 원래 순서대로 정렬하시오.\n\n"), shown).alias("front"), F.concat(F.lit("정답 순서: "), letters, F.lit("\n\n(각 알파벳이 위 선택지의 단락)")).alias("back"))


#: Intervals in days stay below this.
MOST_DAYS = 1 << 62


def sm2(ef: float, interval: int, reps: int, q: int) -> tuple[float, int, int]:
    """(ef, interval, reps) after one review of quality ``q``."""
    ef = max(1.3, ef + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
    if q < 3:
        return ef, 1, 0
    grown = 1 if reps == 0 else 6 if reps == 1 else max(int(interval * ef + 0.5), interval + 1)
    return ef, min(grown, MOST_DAYS), reps + 1


def replay(reviews: DataFrame) -> DataFrame:
    """(card, n, ef, interval, reps): the state of each card after all its ``reviews(card, seq, q)`` in order.

    A card's reviews stream through one task; its state is three numbers, however many it has.
    """

    def run(it):
        card, n, state = None, 0, None
        out: list = []

        def rows():
            cards, ns, states = zip(*out, strict=True)
            ef, interval, reps = zip(*states, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(cards, kind), pa.array(ns, pa.int32()), pa.array([round(x, 6) for x in ef]), pa.array(interval, pa.int64()), pa.array(reps, pa.int64())], names=["card", "n", "ef", "interval", "reps"])

        kind = None
        for batch in it:
            kind = batch.schema.field("card").type
            for c, q in zip(batch.column("card").to_pylist(), batch.column("q").to_pylist(), strict=True):
                if n and c != card:
                    out.append((card, n, state))
                    n = 0
                if not n:
                    card, state = c, (2.5, 0, 0)
                n, state = n + 1, sm2(*state, q)
            if out:
                yield rows()
                out = []
        if n:
            out.append((card, n, state))
            yield rows()

    kind = reviews.schema["card"].dataType.simpleString()
    rows = reviews.where("q is not null").select("card", "seq", F.col("q").cast("int").alias("q")).repartition("card").sortWithinPartitions("card", "seq")
    return rows.mapInArrow(run, f"card {kind}, n int, ef double, interval long, reps long")


def verdicts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, marker, score, verdict): each marker in range of ``answers(answer_id, answer)`` against its source.

    ``sources(answer_id, marker, text)``. The sentences that hold the marker are sorted, made distinct
    and joined before they are scored against the whole source.
    """
    found = answers.select("answer_id", "answer", F.explode(F.array_distinct(T.markers(F.col("answer")))).alias("marker"))
    held = F.filter(T.sentences(F.col("answer")), lambda s: F.contains(s, F.concat(F.lit("[S"), F.col("marker").cast("string"), F.lit("]"))))
    plain = F.transform(held, lambda s: F.btrim(F.regexp_replace(s, r"\s*\[S[0-9]+\]", "")))
    rows = found.withColumn("said", F.array_join(F.array_sort(F.array_distinct(plain)), " ")).join(sources, ["answer_id", "marker"])
    score = T.shares_six(F.col("said"), F.col("text"))
    return rows.select("answer_id", "marker", score.alias("score"), T.verdict(score).alias("verdict"))


def weak_areas(facts: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, similarity): chunks linked to active corrections, the strongest link of each."""
    active = facts.where("status = 'active' and kind = 'correction'").select("fact_id")
    return links.join(active, "fact_id").join(chunks.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.max("similarity").alias("similarity"))
