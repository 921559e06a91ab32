"""Chunkers: sentence chunks, and window chunks with a separator ladder, whole code fences and sentence ends."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialised

SENTENCE_TARGET, SENTENCE_SPLIT, SENTENCE_LEAST = 500, 750, 150
LEAST, MOST, OVERLAP, FENCED_MOST = 2400, 4000, 480, 8000
#: Texts of an Arrow batch that a task holds cut up; a batch may bring ten thousand.
AT_ONCE = 64
#: A trimmed chunk keeps at least so many characters.
TRIMMED_LEAST = 100
FENCE = re.compile(r"(?m)^[ \t]*(?:```|~~~).*$")
#: Everything up to the end of the last sentence that white space follows.
LAST_SENTENCE = re.compile(r"(?s).*[.!?。！？](?=\s)")


def sentence_pieces(text: str) -> list[tuple[int, str]]:
    """(offset, chunk): sentences gathered to some 500 characters; a short last chunk joins the one before."""
    parts, at = [], 0
    for m in re.finditer(r"(?:[.!?。！？](?=\s)|\n)\s*|\Z", text):
        if m.end() > at:
            parts.append((at, text[at : m.end()]))
            at = m.end()
    out: list[tuple[int, str]] = []
    held, start = "", 0
    for offset, part in parts:
        pieces = [(offset + k, part[k : k + SENTENCE_TARGET]) for k in range(0, len(part), SENTENCE_TARGET)] if len(part) > SENTENCE_SPLIT else [(offset, part)]
        for o, p in pieces:
            if held and len(held) + len(p) > SENTENCE_TARGET:
                out.append((start, held))
                held = ""
            start = o if not held else start
            held += p
    if held:
        if out and len(held.strip()) < SENTENCE_LEAST:
            out[-1] = (out[-1][0], out[-1][1] + held)
        else:
            out.append((start, held))
    return [(o, c) for o, c in out if c.strip()]


def _cut(text: str, lo: int, hi: int) -> int:
    """Where to end a window that may reach from lo to hi: after the last separator of the best kind, else at hi."""
    for sep in ("\n\n", "\n"):
        if (at := text.rfind(sep, lo, hi)) >= 0:
            return at + len(sep)
    if m := re.compile(r"(?s).*[.!?。！？]\s+").match(text, lo, hi):
        return m.end()
    at = text.rfind(" ", lo, hi)
    return at + 1 if at >= 0 else hi


def _healed(text: str, start: int, end: int) -> int:
    """The end of a window whose open code fence is closed, if FENCED_MOST characters suffice."""
    fences = sum(1 for _ in FENCE.finditer(text, start, end))
    if fences % 2 == 0:
        return end
    limit = min(len(text), start + FENCED_MOST)
    close = next((m for m in FENCE.finditer(text, start, limit) if m.start() >= end or m.end() > end), None)
    return min(limit, close.end() + 1) if close else limit


def _trimmed(text: str, start: int, end: int) -> int:
    """The end cut back to the last inner sentence end behind the last fence, unless little would be left."""
    if text[start:end].rstrip()[-1:] in ".!?。！？":
        return end
    last = start
    for m in FENCE.finditer(text, start, end):
        last = m.end()
    m = LAST_SENTENCE.match(text, last, end)
    return m.end() if m and m.end() - start >= TRIMMED_LEAST else end


def window_pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) windows that overlap by OVERLAP and cover the text.

    A window of LEAST to MOST characters ends at the best separator, is extended until its code fences
    are closed, then cut back to a sentence end; the last one keeps the text's end.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        end = n
        if n - start > MOST:
            end = _healed(text, start, _cut(text, start + LEAST, start + MOST))
            end = _trimmed(text, start, end) if end < n else n
        out.append((start, end))
        if end >= n:
            break
        start = max(start + 1, end - OVERLAP)
    return out


def _cutting(cut):
    """(doc_id, text) -> a row for each piece that ``cut`` makes, AT_ONCE texts at a time."""

    def run(it):
        for batch in (whole.slice(at, AT_ONCE) for whole in it for at in range(0, whole.num_rows, AT_ONCE)):
            at, ords, starts, texts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (start, piece) in enumerate(cut(text or "")):
                    at.append(i)
                    ords.append(k)
                    starts.append(start)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ords, pa.int32()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "ord", "span_start", "text"])

    return run


def _rows(df: DataFrame, cut) -> DataFrame:
    """(doc_id, ord, span_start, text) of each document's pieces; texts are cut where they lie, in Arrow batches."""
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(_cutting(cut), f"doc_id {kind}, ord int, span_start long, text string")


def sentence_chunks(df: DataFrame) -> DataFrame:
    return _rows(df, sentence_pieces)


def windows(df: DataFrame) -> DataFrame:
    """(doc_id, ord, span_start, text, token_count) of overlapping windows."""
    out = _rows(df, lambda t: [(a, t[a:b]) for a, b in window_pieces(t) if t[a:b].strip()])
    return out.withColumn("token_count", T.token_estimate(F.col("text")))


def _placed(it):
    """(doc_id, part, section_path, page, text) in order of book and part -> the windows of each text, their number among the book's in this task, and how many the part has."""
    book, n = None, 0
    for batch in (whole.slice(at, AT_ONCE) for whole in it for at in range(0, whole.num_rows, AT_ONCE)):
        at, places, ords, many, starts, texts = [], [], [], [], [], []
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            book, n = doc, n if doc == book else 0
            spans = [(a, b) for a, b in window_pieces(text or "") if text[a:b].strip()]
            at += [i] * len(spans)
            places += range(n, n + len(spans))
            ords += range(len(spans))
            many += [len(spans)] * len(spans)
            starts += [a for a, _ in spans]
            texts += [text[a:b] for a, b in spans]
            n += len(spans)
        own = batch.select([0, 2, 3]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(places, pa.int64()), pa.array(ords, pa.int32()), pa.array(many, pa.int32()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "section_path", "page", "place", "k", "many", "span_start", "text"])


def sequence(parts: DataFrame) -> DataFrame:
    """(doc_id, ord, section_path, page, span_start, text, token_count, prev_ord, next_ord, parent_ord).

    ``parts(doc_id, part, section_path, page, text)`` are a book's sections or pages, ``part`` their order and
    unique in the book. ``ord`` is dense over the whole book; neighbours and the parent, a part's first chunk, lie
    in the same part. A blank part has no chunk. Parts are dealt by range of book and place, so a book of any
    length lies in many tasks; each numbers its own chunks, to which those of the book in earlier tasks are added.
    """
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    dealt = parts.select("doc_id", "part", "section_path", "page", "text").repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part")
    schema = f"doc_id {kinds['doc_id']}, section_path {kinds['section_path']}, page {kinds['page']}, place long, k int, many int, span_start long, text string"
    rows = materialised(dealt.mapInArrow(_placed, schema).withColumn("task", F.spark_partition_id()))
    earlier = F.sum("chunks").over(Window.partitionBy("doc_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.groupBy("doc_id", "task").agg(F.count("*").alias("chunks")).select(F.col("doc_id").alias("_book"), F.col("task").alias("_task"), earlier.alias("earlier"))
    begun = F.broadcast(begun.where("earlier > 0"))  # a book that an earlier task began: one a task at most
    rows = rows.join(begun, F.col("doc_id").eqNullSafe(F.col("_book")) & (F.col("task") == F.col("_task")), "left")
    n = (F.col("place") + F.coalesce("earlier", F.lit(0))).cast("int")
    rows = rows.select("*", n.alias("n"))
    inner = F.col("k") > 0
    return rows.select("doc_id", F.col("n").alias("ord"), "section_path", "page", "span_start", "text", T.token_estimate(F.col("text")).alias("token_count"), F.when(inner, F.col("n") - 1).alias("prev_ord"), F.when(F.col("k") + 1 < F.col("many"), F.col("n") + 1).alias("next_ord"), F.when(inner, F.col("n") - F.col("k")).alias("parent_ord"))


def section_chunks(sections: DataFrame) -> DataFrame:
    """``sequence`` of parsed ``sections(doc_id, ord, path, page, body)``."""
    return sequence(sections.select("doc_id", F.col("ord").alias("part"), F.col("path").alias("section_path"), "page", F.col("body").alias("text")))


def page_chunks(pages: DataFrame) -> DataFrame:
    """``sequence`` of ``pages(doc_id, page_texts)``: each page is a part ``p.N``; an unreadable page (null) is empty."""
    rows = pages.select("doc_id", F.posexplode("page_texts").alias("part", "text"))
    page = F.col("part") + 1
    return sequence(rows.select("doc_id", "part", F.concat(F.lit("p."), page.cast("string")).alias("section_path"), page.alias("page"), F.coalesce("text", F.lit("")).alias("text")))
