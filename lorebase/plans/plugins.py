"""Plug-in points: embedders and rerankers run as Arrow batches; text generation degrades to its fallback."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.counting import KNOWN
from ..functions.vectors import Embedder



def hash_embedder(dim: int) -> Embedder:
    """Deterministic: signed token hashes, normalised. For tests and for runs without a model."""

    places: dict[str, int] = {}

    def place(token: str) -> int:
        h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        return h % dim + (0 if h >> 63 else dim)

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            tokens = (text or "").lower().split()
            if len(places) > KNOWN:
                places.clear()
            for token in set(tokens).difference(places):
                places[token] = place(token)
            counts = np.bincount([places[t] for t in tokens], minlength=2 * dim) if tokens else np.zeros(2 * dim)
            v = (counts[:dim] - counts[dim:]).astype(np.float32)
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return out

    return embed


def embedded(text: Column, make: Callable[[], Embedder], prefix: str = "") -> Column:
    """Vectors of ``text``; the model is made once in each task and fed batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series([None if v is None else list(map(float, v)) for v in model([prefix + (t or "") for t in s])])

    return run(text)


def reranked(query: Column, candidate: Column, score: Callable[[str, str], float] | None = None) -> Column:
    """A reranker's score of a candidate; without one, the six-character overlap."""
    if score is None:
        return T.shares_six(query, candidate)

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([score(a, b) for a, b in zip(q, c, strict=True)])

    return run(query, candidate)


def rewritten(query: Column, answer: Column, label: str = "rewrite") -> Column:
    """A rewriting model's answer, or the query itself if that is missing or blank."""
    return F.coalesce(T.unquoted_line(answer, label), query)


#: A text-generation model: request in, answer out; an exception or a blank answer means that the fallback holds.
Generator = Callable[[str], str]


def generated(prompt: Column, make: Callable[[], Generator] | None) -> Column:
    """A model's answers, made once in each task; null without a model, and where it fails."""
    if make is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def one(text):
            try:
                return model(text) if text is not None else None
            except Exception:  # a model's failure is the fallback's turn
                return None

        for s in batches:
            yield s.map(one)

    return run(prompt)


def hypothetical(query: Column, answer: Column) -> Column:
    """A hypothetical answer to search by: all lines, label and quotes off; the query itself if it is missing or blank."""
    text = F.btrim(F.regexp_replace(F.btrim(answer, F.lit(" \n\r\t")), r"^(?i:hypothetical answer|answer|hyde)\s*:\s*", ""), F.lit(" \n\r\t"))
    return F.coalesce(F.nullif(F.regexp_replace(text, r'(?s)^"(.*)"$', "$1"), F.lit("")), query)


def summary(answer: Column, older: Column, limit: int = 600) -> Column:
    """A history summary in one line; without one, the older text cut at ``limit`` characters."""
    cut = F.when(F.length(older) > limit, F.concat(F.substring(older, 1, limit), F.lit("…"))).otherwise(older)
    return F.coalesce(T.unquoted_line(answer, "summary"), cut)


def choice_card(answer: Column) -> Column:
    """Struct (question, options, correct) of a model's JSON card; null unless it has four options and a valid place among them."""
    card = F.from_json(T.json_object(answer), "question string, options array<string>, correct int")
    whole = (F.btrim(card["question"]) != "") & (F.size(card["options"]) == 4) & card["correct"].between(0, 3) & ~F.exists(card["options"], lambda o: o.isNull() | (F.btrim(o) == ""))
    return F.when(whole, card)


def titled(answer: Column, first_message: Column) -> Column:
    """A model's title for a session, or one made of its first message."""
    return F.coalesce(T.unquoted_line(answer, "title"), T.title_of(first_message))


#: What each strength level runs besides retrieval and packing, in this order; read by the answering path.
STRENGTH = {"fast": ("expand", "clean"), "balanced": ("rewrite", "expand", "window", "merge", "diverse", "clean"), "accurate": ("rewrite", "hyde", "expand", "window", "merge", "diverse", "clean")}
