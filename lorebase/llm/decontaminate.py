"""Benchmark decontamination: a prefix-filtered set join on word shingles, DataFrame operations only.

A benchmark item is its set of windows, a window its set of shingles. For a window to be contained
whole, any one of its shingles must be there, so a prefix of one shingle is enough: the rarest of the
window's shingles by its count over all documents. Documents are joined on these alone; positions and
lengths bound the candidates, and the words of each candidate are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, sized

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5


def words(text: Column) -> Column:
    """The words of ``text`` after A-Z are lower-cased; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(w: Column, n: Column, size: int) -> Column:
    """Structs (pos, h) of all ``size``-word shingles in order."""
    one = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(w, i + j) for j in range(size)]).alias("h"))
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), one)).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, window): each item's runs of WINDOW words, or all its words if they are fewer."""
    w = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - WINDOW + 1, F.lit(1))), lambda i: F.slice("w", i, WINDOW))
    return w.select("item_id", F.explode(cut).alias("window")).distinct()


def find(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, n_words) of each row of ``docs(doc_id, text)``, (doc_id, text_hash, found)).

    ``found`` holds structs (start, size, window) by position, counted in words from 0, for each distinct
    document with an occurring window. Every text is split into words once; a second time only those
    that share a window's rarest shingle.
    """
    distinct = checkpointed(windows(benchmark).select("window").distinct().withColumn("size", F.size("window")))
    sizes = sorted(r[0] for r in distinct.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most SHINGLE
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    split = rows.select("doc_id", "text_hash", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    of_size = lambda k: (F.col("size") >= SHINGLE) if k == SHINGLE else (F.col("size") == k)
    none = F.array().cast("array<struct<pos:int,h:bigint>>")
    of_window = F.concat(none, *(F.when(of_size(k), _shingles(F.col("window"), F.col("size"), k)).otherwise(none) for k in sizes))
    needles = checkpointed(distinct.select("window", "size", F.inline(of_window)).withColumnRenamed("pos", "off"))
    tokens = checkpointed(needles.select("h").distinct().withColumn("known", F.lit(True)))
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.col("n").cast("long").alias("h")))  # one row a text tells its words
    each = split.select("doc_id", "text_hash", F.inline(F.concat(own, *(_shingles(F.col("w"), F.col("n"), k) for k in sizes))))
    seen = checkpointed(each.join(sized(tokens, tokens.count()), "h", "left").where("pos < 0 or known").select("doc_id", "text_hash", "pos", "h"))
    counted = seen.where("pos < 0").select("doc_id", "text_hash", F.col("h").alias("n_words"))
    hits = seen.where("pos >= 0")
    counts = hits.groupBy("h").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "off", "h")).alias("rarest")
    prefix = needles.join(counts, "h", "left").groupBy("window", "size").agg(F.count_if(F.col("n").isNull()).alias("lacking"), rarest).where("lacking = 0")
    prefix = checkpointed(prefix.select("window", "size", "rarest.off", "rarest.h"))
    at = hits.join(sized(prefix, 8 * prefix.count()), "h").select("doc_id", "text_hash", (F.col("pos") - F.col("off")).alias("start"), "size", "window").where("start >= 0")
    near = at.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "size", "window")).alias("near"))
    near = checkpointed(near.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}))
    texts = rows.join(sized(near.select("d", "t"), near.count()), rows.doc_id.eqNullSafe(F.col("d")) & rows.text_hash.eqNullSafe(F.col("t")), "left_semi").distinct()
    both = texts.join(near, texts.doc_id.eqNullSafe(near.d) & texts.text_hash.eqNullSafe(near.t))
    both = checkpointed(both.select("doc_id", "text_hash", words(F.col("text")).alias("w"), "near"))  # else each comparison would split the text again
    both = both.withColumn("n", F.size("w"))
    holds = lambda c: (c.start + c.size <= F.col("n")) & (F.slice("w", c.start + 1, c.size) == c.window)
    found = both.select("doc_id", "text_hash", F.array_sort(F.filter("near", holds)).alias("found")).where(F.size("found") > 0)
    return counted, checkpointed(found)


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted (start, size) spans."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("hit"))

    def step(acc, x):
        end = x.start + x.size
        return F.struct(F.greatest(acc.reach, end).alias("reach"), (acc.hit + F.greatest(F.lit(0), end - F.greatest(acc.reach, x.start))).alias("hit"))

    return F.aggregate(spans, zero, step, lambda acc: acc.hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of ``docs``.

    A document word is hit if it lies in an occurrence of an item's window. Null and empty texts have
    no words. Benchmark rows without item_id or words are left out; rows sharing an item_id are one
    item. Rows sharing a doc_id are judged each by its own text; overlapping windows hit a word once.
    Whole texts are split, however long. An empty benchmark hits nothing; empty documents give no rows;
    other columns are ignored.
    """
    counted, found = find(docs, benchmark)
    pairs = found.select("doc_id", "text_hash", F.explode("found.window").alias("window")).distinct()
    items = pairs.join(windows(benchmark), "window").groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    items = items.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    both = found.join(items, found.doc_id.eqNullSafe(items.d) & found.text_hash.eqNullSafe(items.t))
    both = both.select("d", "t", _covered(F.col("found")).alias("hit"), "items")
    both = counted.join(both, counted.doc_id.eqNullSafe(both.d) & counted.text_hash.eqNullSafe(both.t), "left")
    listed, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("hit", F.lit(0).cast("long"))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(listed)), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark; null texts hold none."""
    _, found = find(docs, benchmark)
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    text_hash = F.xxhash64(docs["text"].cast("string"))
    return docs.join(sized(found, found.count()), docs["doc_id"].eqNullSafe(found["_d"]) & text_hash.eqNullSafe(found["_t"]), "left_anti")


ORACLE = r"""
with dw as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
win as (select distinct item_id, array_to_string(w[i + 1:i + 10], ' ') t, least(len(w), 10) k from (select item_id, w, unnest(range(greatest(len(w) - 9, 1))) i from bw where len(w) > 0)),
sizes as (select distinct k from win),
dg as (select r, i, k, array_to_string(w[i + 1:i + k], ' ') t from (select r, w, k, unnest(range(len(w) - k + 1)) i from dw, sizes where len(w) >= k)),
occ as (select distinct r, i, k, item_id from dg join win using (t, k)),
hit as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + k)) p from occ) group by r),
its as (select r, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct r, item_id::varchar s from occ) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hit using (r) left join its using (r)
"""
