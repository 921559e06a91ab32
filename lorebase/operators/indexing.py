"""Indexes and caches kept in step with their tables: postings, embedding batches, links, puts, token replays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import Embedder
from ..session import materialised
from ..sources.snapshots import Snapshot, Store
from .retrieval import sized

#: Chunks that are embedded, and lost at most, at once; attempts after which a chunk has failed.
BATCH, ATTEMPTS = 32, 3
#: Texts of an Arrow batch whose terms a task holds; a batch may bring ten thousand.
AT_ONCE = 64


def _counted(it):
    """(doc_id, text) -> a row for each term of a text, AT_ONCE texts at a time."""
    find = re.compile(r"[^\W_]+").findall
    for batch in (whole.slice(at, AT_ONCE) for whole in it for at in range(0, whole.num_rows, AT_ONCE)):
        n, terms, tf, size = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = find(text or "")
            count = Counter(found)
            n.append(len(count))
            size.append(len(found))
            terms += count
            tf += count.values()
        docs = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), docs, pa.array(tf, pa.int32()), pa.array(np.repeat(size, n), pa.int32())], names=["term", "doc_id", "tf", "doc_len"])


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_len) of ``docs(doc_id, text)``, one row a document; a text without tokens has none. Terms are counted where their text lies."""
    text = T.index_text(F.col("text").cast("string")).alias("text")
    return docs.select("doc_id", text).mapInArrow(_counted, f"term string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tf int, doc_len int")


def replaced(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert-or-replace on several key columns: the row of each key with the latest ``version``; of equal ones the new."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def cache_put(cache: DataFrame, new: DataFrame, as_of: Column, dimension: int | None = None) -> DataFrame:
    """``cache(key, ..., created, last_hit)`` after a put of ``new(key, ...)``: a known key keeps its creation time and is refreshed.

    With ``dimension`` the embeddings of ``new`` must have that length; another is an error.
    """
    if dimension is not None:
        wrong = F.raise_error(F.concat(F.lit(f"dimension must be {dimension}: "), F.size("embedding").cast("string")))
        new = new.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(wrong))
    known = cache.select("key", F.col("created").alias("_created"))
    fresh = new.join(known, "key", "left").withColumn("created", F.coalesce("_created", as_of)).withColumn("last_hit", as_of).drop("_created")
    return cache.join(new.select("key"), "key", "left_anti").unionByName(fresh.select(*cache.columns))


def read_through(lookups: DataFrame, made: Callable[[Column], Column], seconds: int) -> DataFrame:
    """(key, id, ts, hit, value) of ``lookups(key, id, ts, text)`` in order of time: a value used in the ``seconds`` before is a hit, which refreshes it.

    A miss has its value made of its own text; ``made`` sees null for hits, so a model works on misses alone.
    """
    w = Window.partitionBy("key").orderBy("ts", "id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = lookups.withColumn("hit", F.coalesce(at - F.lag(at).over(w) <= 1_000_000 * seconds, F.lit(False)))
    rows = rows.withColumn("made", made(F.when(~F.col("hit"), F.col("text"))))
    value = F.last("made", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("key", "id", "ts", "hit", value.alias("value"))


def embed_pending(chunks: DataFrame, cache: DataFrame, make: Callable[[], Embedder], model: str, dimension: int) -> DataFrame:
    """(chunk_id, book, embedding, status, attempts, cached) of the pending ones of ``chunks(chunk_id, book, text, status, attempts)``.

    Pending is a null or failed status. Keys found in ``cache(key, embedding)`` need no model; the others
    go to it by BATCH. If a batch fails its rows are tried one by one, and a row that fails alone (a
    blank text, an error, another dimension) counts an attempt. Vectors, status and attempts are one
    table, so that one write commits them all; ``progress`` is read off it.
    """
    todo = chunks.where("status is null or status = 'failed'").withColumn("key", T.embedding_key(F.coalesce("text", F.lit("")), F.lit(model)))
    rows = todo.join(sized(cache.select("key", F.col("embedding").alias("known"))), "key", "left").select("chunk_id", "book", "text", "attempts", "known")
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def run(it):
        embed = make()

        def vectors(texts: list[str]) -> list:
            try:
                got = [None if v is None else [float(x) for x in v] for v in embed(texts)]
                if len(got) == len(texts):
                    return [v if v is not None and len(v) == dimension else None for v in got]
            except Exception:  # the whole batch failed: its rows are tried alone
                pass
            return [None] if len(texts) == 1 else [v for t in texts for v in vectors([t])]

        for batch in it:
            texts, known = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            out: list = list(known)
            open_rows = [i for i, (t, v) in enumerate(zip(texts, known, strict=True)) if v is None and (t or "").strip()]
            for at in range(0, len(open_rows), BATCH):
                some = open_rows[at : at + BATCH]
                for i, v in zip(some, vectors([texts[i] for i in some]), strict=True):
                    out[i] = v
            attempts = [n if v is not None else (n or 0) + 1 for n, v in zip(batch.column(3).to_pylist(), out, strict=True)]
            status = ["done" if v is not None else "failed" if n >= ATTEMPTS else None for n, v in zip(attempts, out, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float32())), pa.array(status, pa.string()), pa.array(attempts, pa.int64()), pa.array([v is not None for v in known])]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "book", "embedding", "status", "attempts", "cached"])

    return rows.mapInArrow(run, f"chunk_id {kinds['chunk_id']}, book {kinds['book']}, embedding array<float>, status string, attempts long, cached boolean")


def progress(outcome: DataFrame) -> DataFrame:
    """(book, chunks, done, failed, pending, cached) of ``embed_pending``'s rows."""
    count = lambda c, name: F.count_if(c).alias(name)
    return outcome.groupBy("book").agg(F.count("*").alias("chunks"), count(F.col("status") == "done", "done"), count(F.col("status") == "failed", "failed"), count(F.col("status").isNull(), "pending"), count(F.col("cached"), "cached"))


def commit(outcome: DataFrame, store: Store, batch_id: int) -> int:
    """Vectors, the chunks' status and their books' progress of one batch, published together in the tables vectors, chunks and jobs.

    Progress counts all chunks of a book that have been looked at so far. A batch that was published before
    changes nothing, and an empty one neither. Returns the version.
    """
    outcome, change = materialised(outcome), store.begin()
    if outcome.isEmpty():
        return change.base.version
    state = outcome.select("chunk_id", "book", "status", "attempts", "cached")
    seen = state
    if "chunks" in change.base.tables:
        own = change.base.read("chunks").join(state.select("book").distinct(), "book", "left_semi")
        seen = own.join(state.select("chunk_id"), "chunk_id", "left_anti").unionByName(state)
    vectors = outcome.where("status = 'done'").select("chunk_id", "embedding")
    for name, rows, key in (("vectors", vectors, "chunk_id"), ("chunks", state, "chunk_id"), ("jobs", progress(seen), "book")):
        (change.upsert(name, rows, (key,)) if name in change.base.tables else change.append(name, rows))
    return change.reads("chunks").commit(batch=("embedding", batch_id))


def build_tier(store: Store, tier: str, chunks: DataFrame, cache: DataFrame, make: Callable[[], Embedder], model: str, dimension: int, most: int | None = None) -> int:
    """Embed the chunks of ``chunks(chunk_id, book, text)`` that the table ``tier`` lacks (``most`` of them, by id), and drop what has no chunk any more, in one commit.

    Built behind a tier that is complete, a second one may take many calls; ``tier_vectors`` changes over when it is.
    """
    change = store.begin().reads(tier)
    made = change.base.read(tier) if tier in change.base.tables else None
    open_ = chunks if made is None else chunks.join(made.select("chunk_id"), "chunk_id", "left_anti")
    open_ = open_ if most is None else open_.orderBy("chunk_id").limit(most)
    rows = open_.select("chunk_id", "book", "text", F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("attempts"))
    done = embed_pending(rows, cache, make, model, dimension).where("status = 'done'").select("chunk_id", "embedding")
    if made is not None:
        change.delete(tier, made.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"))
    return change.append(tier, done).commit()


def tier_vectors(snapshot: Snapshot, chunks: DataFrame, first: str, second: str) -> DataFrame:
    """The second tier's vectors if they cover ``chunks(chunk_id)``, else the first's: both as of one snapshot."""
    if second in snapshot.tables:
        vectors = snapshot.read(second)
        if chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti").isEmpty():
            return vectors
    return snapshot.read(first)


def paused(events: DataFrame) -> DataFrame:
    """(worker, at, running): state of each worker after each of ``events(worker, id, ts, kind, owner)``.

    A pause is kept by its owner: chat resumes only the pause that chat made, so a worker that the user
    paused stays so. ``kind`` is pause or resume, ``owner`` who asked.
    """
    w = Window.partitionBy("worker", "owner").orderBy("ts", "id")
    own = events.withColumn("held", F.col("kind") == "pause")
    changes = own.withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(False))).withColumn("step", F.col("held").cast("int") - F.col("before").cast("int"))
    every = Window.partitionBy("worker").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("holders", F.sum("step").over(every)).select("worker", "id", (F.col("holders") == 0).alias("running"))


def replayed(tokens: DataFrame) -> DataFrame:
    """(handle, text, n_tokens, finished) of a token stream's log ``tokens(handle, seq, kind, delta)``: deltas in order, up to a cancel."""
    stop = F.min(F.when(F.col("kind") == "cancel", F.col("seq"))).over(Window.partitionBy("handle"))
    kept = tokens.withColumn("stop", stop).where("stop is null or seq < stop")
    out = kept.groupBy("handle").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "delta")))).alias("d"), F.max(F.col("kind") == "done").alias("finished"))
    return out.select("handle", F.array_join("d.delta", "").alias("text"), F.size("d").cast("long").alias("n_tokens"), "finished")


def trace(spans: DataFrame) -> DataFrame:
    """(trace, name, ms, notes) of ``spans(trace, name, kind, id, ts, note)``: each begin with the next end of its name, notes between."""
    w = Window.partitionBy("trace", "name").orderBy("ts", "id")
    rows = spans.withColumn("n", F.count_if(F.col("kind") == "begin").over(w)).where("n > 0")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    out = rows.groupBy("trace", "name", "n").agg(of("begin").alias("a"), of("end").alias("b"), F.count_if(F.col("kind") == "note").alias("notes"))
    ms = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1000
    return out.select("trace", "name", "n", F.round(ms, 3).alias("ms"), "notes")
