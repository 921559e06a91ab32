"""Entity graph: key terms of chunks, and expansion over shared terms."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counting import top_terms
from .retrieval import sized

PER_CHUNK, SEED_TERMS, NEIGHBOURS = 10, 12, 2

# Particles (longest first) and stop words.
PARTICLES = ("으로부터", "에서는", "에게서", "라고", "이라고", "에서", "에게", "으로", "처럼", "까지", "부터", "보다", "마다", "조차", "마저", "이나", "거나", "든지", "은", "는", "이", "가", "을", "를", "의", "에", "도", "와", "과", "만", "로", "랑")
STOPS = (
    "그리고", "그러나", "하지만", "그래서", "또한", "또는", "이것", "그것", "저것", "여기", "거기", "저기", "이런", "그런", "저런", "때문", "경우", "통해", "위해", "대해", "관해", "있다", "없다", "이다", "하다", "되다", "같다", "다음", "이전",
    "the", "and", "but", "for", "with", "this", "that", "these", "those", "from", "into", "are", "was", "were", "has", "have", "had", "not", "you", "your", "can", "will", "한다", "한",
)


_OUT = frozenset((*PARTICLES, *STOPS))


def term_of(token: str, least: int = 2) -> str | None:
    """A token as a term: lower-cased, of Hangul the first particle that fits and leaves ``least`` characters cut off; None if it isn't one."""
    token = token.lower()
    if token[0] >= "가":
        for p in PARTICLES:
            if token.endswith(p) and len(token) - len(p) >= least:
                token = token[: -len(p)]
                break
    return None if len(token) < least or token.isdigit() or token in _OUT else token


def entities(docs: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, entity, weight, rnk): the most frequent terms of each chunk.

    Terms are runs of ASCII word characters, lower-cased, and runs of Hangul without their particle;
    digits only, single characters, particles and stop words are out.
    """
    return top_terms(docs, F.col("text").cast("string"), r"[A-Za-z0-9_]+|[가-힣]+", partial(term_of, least=least), PER_CHUNK, ("entity", "weight", "rnk"))


def expand(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, doc_id, strength, rnk): chunks of the seeds' book that share the seeds' strongest terms.

    ``hits(query_id, doc_id)`` are the seeds, ``edges(book, doc_id, entity, weight)`` the graph. Twelve
    terms of a query, by summed weight, then name; at most two neighbours, seeds excluded.
    """
    seeds = hits.select("query_id", "doc_id").distinct()
    own = edges.join(sized(seeds), "doc_id").groupBy("query_id", "book", "entity").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("query_id").orderBy(F.desc("w"), "entity", "book")
    top = own.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SEED_TERMS).select("query_id", "book", "entity")
    near = edges.join(sized(top), ["book", "entity"]).join(sized(seeds), ["query_id", "doc_id"], "left_anti")
    strength = near.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("strength"))
    order = Window.partitionBy("query_id").orderBy(F.desc("strength"), "doc_id")
    return strength.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= NEIGHBOURS)


def append(hits: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``hits(query_id, doc_id, score)`` and their neighbours, scored below the least hit by relative strength."""
    base = hits.groupBy("query_id").agg(F.greatest(F.min("score") * 0.9, F.lit(1e-6)).alias("base"))
    most = neighbours.groupBy("query_id").agg(F.max("strength").alias("most"))
    extra = neighbours.join(base, "query_id").join(most, "query_id")
    return hits.select("query_id", "doc_id", "score").unionByName(extra.select("query_id", "doc_id", F.round(F.col("base") * F.col("strength") / F.col("most"), 9).alias("score")))
