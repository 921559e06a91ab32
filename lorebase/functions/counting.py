"""The most frequent terms of each text, counted where it lies."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens whose terms a task remembers.
KNOWN = 100_000


def top_terms(docs: DataFrame, text: Column, pattern: str, term_of: Callable[[str], str | None], most: int, names: tuple[str, str, str]) -> DataFrame:
    """(doc_id, term, count, rank) under ``names``: the ``most`` terms of each text by count, then name.

    Tokens are the matches of ``pattern``; ``term_of`` names a token's term, or None. A text's tokens
    never leave its task: one narrow pass takes the place of a shuffle of all of them.
    """

    def run(it):
        find, known = re.compile(pattern).findall, {}
        for batch in it:
            rows, terms, counts, ranks = [], [], [], []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                found: Counter = Counter()
                for token, n in Counter(find(whole or "")).items():
                    if token not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[token] = term_of(token)
                    if known[token] is not None:
                        found[known[token]] += n
                for rank, (term, n) in enumerate(heapq.nsmallest(most, found.items(), key=lambda x: (-x[1], x[0])), 1):
                    rows.append(i)
                    terms.append(term)
                    counts.append(n)
                    ranks.append(rank)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text.alias("text")).mapInArrow(run, f"doc_id {kind}, {names[0]} string, {names[1]} long, {names[2]} int")
