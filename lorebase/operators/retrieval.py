"""Retrieval over a batch of questions: fusion, expansion, diversity, packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..session import materialised

K1, B = 1.2, 0.75
RRF_K, DEPTH, TOP = 60, 20, 10
#: A side is broadcast up to so many rows and bytes; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    size = F.lit(0)
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        own = F.octet_length(c) if isinstance(field.dataType, S.StringType | S.BinaryType) else 8 * F.size(c) if isinstance(field.dataType, S.ArrayType | S.MapType) else F.lit(8)
        size = size + F.coalesce(F.greatest(own, F.lit(0)), F.lit(0))
    return size


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has no more than ``limit`` rows and BROADCAST_BYTES bytes."""
    got = df.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(_bytes(df).cast("long")).alias("b")).first()
    return F.broadcast(df) if got.n <= limit and (got.b or 0) <= BROADCAST_BYTES else df


def ranked(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each query_id with their rank; the limit applies in each task before the exchange."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), tie)
    return df.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def fuse(vec: DataFrame, fts: DataFrame, weights: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """(query_id, doc_id, rrf_score, rnk): weighted reciprocal-rank fusion of two rankings (query_id, doc_id, rnk).

    ``weights(query_id, w_vec, w_fts)`` default to one. A side that lacks a document adds nothing; both
    sides are one union and one aggregation, without an outer join.
    """
    both = vec.select("query_id", "doc_id", "rnk", F.lit("v").alias("side")).unionByName(fts.select("query_id", "doc_id", "rnk", F.lit("f").alias("side")))
    if weights is not None:
        both = both.join(sized(weights), "query_id")
        weight = F.when(F.col("side") == "v", F.col("w_vec")).otherwise(F.col("w_fts"))
    else:
        weight = F.lit(1.0)
    scored = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (F.col("rnk") + RRF_K)), 9).alias("rrf_score"))
    return ranked(scored, "rrf_score", "doc_id", k)


def with_links(chunks: DataFrame, book: str = "source", section: str = "section_no", order: str = "doc_id") -> DataFrame:
    """Chunk links: neighbours in the section, and its first chunk as parent (null for that one).

    For chunks without their texts, so that the window moves a few numbers a chunk; ``with_texts`` adds those of the hits.
    """
    w = Window.partitionBy(book, section).orderBy(order)
    first = F.first(order).over(w)
    return chunks.select("*", F.lag(order).over(w).alias("prev_id"), F.lead(order).over(w).alias("next_id"), F.when(first != F.col(order), first).alias("parent_id"))


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """``hits(doc_id, ...)`` with the text of ``texts(doc_id, text)``; only the hits' texts leave their place."""
    return hits.join(texts.join(sized(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text"), "doc_id")


def sentence_window(hits: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """``hits(doc_id, ...)`` with the text of the chunk between its neighbours, joined by blank lines."""
    near = links.join(sized(hits.select("doc_id").distinct()), "doc_id").select("doc_id", F.posexplode(F.array("prev_id", "doc_id", "next_id")).alias("pos", "near"))
    near = materialised(near.where("near is not null"))
    few = texts.select(F.col("doc_id").alias("near"), "text").join(sized(near.select("near").distinct()), "near", "left_semi")
    window = near.join(few, "near").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))  # three at most
    return hits.join(window, "doc_id").select(*hits.columns, F.array_join("t.text", "\n\n").alias("window_text"))


def merge_parents(hits: DataFrame, chunks: DataFrame, least: int = 2, limit: int = 800) -> DataFrame:
    """(query_id, doc_id, score, source_chunks, pos): siblings replaced by their parent.

    Two or more hits of one parent whose children have under ``limit`` tokens together become the
    parent's row with the sum of scores, at the place of the first of them. ``hits`` has query_id,
    doc_id, score and rnk, ``chunks`` doc_id, parent_id and token_count.
    """
    tokens = F.col("token_count")
    sums = chunks.where("parent_id is not null").groupBy("parent_id").agg(F.sum(F.greatest(tokens, F.lit(0))).alias("child_tokens"))
    known = chunks.select(F.col("doc_id").alias("known_id"))
    h = hits.select("query_id", "doc_id", "score", "rnk").join(chunks.select("doc_id", "parent_id"), "doc_id")
    h = h.join(sums, "parent_id", "left").join(known, F.col("parent_id") == F.col("known_id"), "left")
    together = F.count("*").over(Window.partitionBy("query_id", "parent_id"))
    merges = F.col("known_id").isNotNull() & (together >= least) & (F.col("child_tokens") < limit)
    h = h.withColumn("target", F.when(merges, F.col("parent_id")).otherwise(F.col("doc_id")))
    merged = h.withColumn("merged", merges).groupBy("query_id", "target", "merged").agg(F.round(F.sum("score"), 6).alias("score"), F.array_sort(F.collect_list("doc_id")).alias("source_chunks"), F.min("rnk").alias("pos"))
    return merged.select("query_id", F.col("target").alias("doc_id"), "score", "source_chunks", "pos")


def pack(rows: DataFrame, budget: int, overhead: int, order: str = "rnk", tokens: str = "token_count") -> DataFrame:
    """Rows of each query_id by ``order`` until the next would exceed the budget; then no more.

    Adds used_tokens and marker: kept rows are numbered from the last to the first. A need is positive,
    so the running sum is monotone and a window expresses the stop.
    """
    w = Window.partitionBy("query_id").orderBy(order, "doc_id")
    need = F.col(tokens) + overhead
    kept = rows.withColumn("used_tokens", F.sum(need).over(w)).where(F.col("used_tokens") <= budget)
    back = Window.partitionBy("query_id").orderBy(F.col(order).desc(), F.col("doc_id").desc())
    return kept.withColumn("marker", F.row_number().over(back))


def source_block(marker: Column, book: Column, page: Column, section: Column, n_sources: Column, text: Column) -> Column:
    """One source of a context: a header with what is known of its place, then the text."""
    parts = F.concat_ws(", ", F.when(book != "", F.concat(F.lit("책: "), book)), F.concat(F.lit("p."), page.cast("string")), F.when(section != "", F.concat(F.lit("§"), section)), F.when(n_sources >= 2, F.concat(n_sources.cast("string"), F.lit(" 청크 병합"))))
    return F.concat(F.lit("[S"), marker.cast("string"), F.lit("]"), F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(F.lit("")), F.lit("\n"), text)


def context(packed: DataFrame) -> DataFrame:
    """(query_id, sources_block, citation_map, kept, used_tokens) of packed rows with a ``block`` column."""
    pairs = F.array_sort(F.collect_list(F.struct("marker", "doc_id", "block")))
    out = packed.groupBy("query_id").agg(pairs.alias("p"), F.count("*").alias("kept"), F.max("used_tokens").alias("used_tokens"))
    names = F.transform("p", lambda x: F.concat(F.lit("S"), x.marker.cast("string")))
    return out.select("query_id", F.array_join("p.block", "\n\n").alias("sources_block"), F.map_from_arrays(names, F.col("p.doc_id")).alias("citation_map"), "kept", "used_tokens")


def diverse(candidates: DataFrame, n: int = 6, balance: float = 0.5) -> DataFrame:
    """(query_id, doc_id, pick): greedy maximal marginal relevance over each query's few candidates.

    ``candidates(query_id, doc_id, relevance, vector, query_vector)``. Relevance is the cosine to the
    query where both vectors are there, else the raw score; negative similarity counts as 0; ties go
    to the higher relevance, then the smaller id. A query has a dozen candidates by construction.
    """
    import pandas as pd

    def cos(a, b):
        if a is None or b is None:
            return None
        m = min(len(a), len(b))
        a, b = np.asarray(a[:m], float), np.asarray(b[:m], float)
        norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return float(a @ b / norm) if norm else 0.0

    def pick(pdf):
        rows = pdf.sort_values("doc_id").to_dict("records")
        for r in rows:
            c = cos(r["vector"], r["query_vector"])
            r["rel"] = r["relevance"] if c is None else c
        chosen = []
        while rows and len(chosen) < n:
            def gain(r):
                near = max([max(0.0, cos(r["vector"], c["vector"]) or 0.0) for c in chosen], default=0.0)
                return (round(balance * r["rel"] - (1 - balance) * near, 12), r["rel"], -r["doc_id"])

            best = max(rows, key=gain)
            rows.remove(best)
            chosen.append(best)
        return pd.DataFrame({"query_id": [r["query_id"] for r in chosen], "doc_id": [r["doc_id"] for r in chosen], "pick": range(1, len(chosen) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, pick int")


def boilerplate(passages: DataFrame, least: int = 3, longest: int = 60, scope: str = "query_id") -> DataFrame:
    """(scope, line): short lines that don't end a sentence and occur in ``least`` passages of a scope or more."""
    lines = passages.select(scope, "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), T.clean_line))).alias("line"))
    lines = lines.where((F.col("line") != "") & (F.length("line") <= longest) & ~T.is_sentence_end(F.col("line")))
    return lines.groupBy(scope, "line").agg(F.countDistinct("doc_id").alias("passages")).where(F.col("passages") >= least)


def clean_passages(passages: DataFrame, scope: str = "query_id", renew: bool = True) -> DataFrame:
    """``passages(scope, doc_id, text)`` with cleaned text; a blank result keeps the old text.

    With ``renew`` the token count is that of the text now, as for merged rows; raw rows keep theirs.
    """
    listed = boilerplate(passages, scope=scope).groupBy(scope).agg(F.collect_set("line").alias("noise"))  # short lines of one scope
    out = passages.join(listed, scope, "left")
    lines = F.filter(T.clean_lines(F.col("text")), lambda x: ~F.coalesce(F.array_contains("noise", x), F.lit(False)))
    clean = T.join_clean(lines)
    out = out.withColumn("text", F.when(F.btrim(clean) == "", F.col("text")).otherwise(clean)).drop("noise")
    return out.withColumn("token_count", T.token_estimate(F.col("text"))) if renew else out
