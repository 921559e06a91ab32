"""A stored inverted index with positions, kept in step with its texts, and BM25 searches that read it.

Documents are dealt to blocks by a hash. For each term and block there is one row: the block's documents that
have the term, how often, their lengths and the positions, and what bounds a score in that block (greatest
frequency, least length). Rows lie in folders by a hash of the term's first two letters, ordered by term, so
a search reads the folders and row groups of the asked terms. A changed document makes its block's
rows anew, in one commit. A block's rows go from the task that made them to its files; no exchange or copy of them
lies between. Questions are scored block by block, groups of questions side by side: a row
for a document and a question is never made but for a task's best. In large indexes and for few questions the rare
terms are scored first; a block whose bounds can't reach a question's k-th best of these isn't moved or scored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialised
from ..sources.snapshots import Change, Snapshot, Store
from .retrieval import B, K1, ranked, sized

BUCKETS = 64
#: Documents of a block, and questions that are scored side by side.
BLOCK, SIDE = 1024, 256
#: Of a compacted index a folder's rows of so many blocks lie in one file, so that no task that writes one grows with the index.
FILE = 128
#: Blocks that are made at a time, so that no more texts than theirs lie shuffled, and blocks of a task that makes them.
SLICE, TOGETHER = 512, 8
#: Terms of a block that are scored at once.
TERMS = 1024
#: Letters by which a term finds the longer units that may begin it.
HEAD = 4
#: From so many blocks on and up to so many questions, terms in at most a RARE-th of the documents are scored first.
PRUNE_FROM, PRUNE_ASKED, RARE = 64, 8, 64

_LISTS = "tf array<int>, len array<int>, pos array<int>, n int, max_tf int, min_len int, total int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(2))), F.lit(BUCKETS)).cast("int")


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _of(docs: pa.Array) -> np.ndarray:
    """Ids as numbers, or as objects."""
    return docs.to_numpy() if pa.types.is_integer(docs.type) else np.array(docs.to_pylist(), object)


def _indexed(kind: pa.DataType):
    """(block, doc_id, text) in order of block -> a row for each of its terms, and one without a term for all its documents.

    A token becomes its term's number as it is read; the block's places are then ordered by term at once.
    """

    def rows(block: int, docs: list, tokens: list[np.ndarray], names: dict[str, int]):
        size = np.array(list(map(len, tokens)), np.int32)
        term = np.concatenate(tokens)
        order = np.argsort(term, kind="stable")  # documents and places stay in order
        term, doc = term[order], np.repeat(np.arange(len(docs)), size)[order]
        pos = (np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size))[order].astype(np.int32)
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)  # of a document that has a term, the first place
        tf, who, word = np.diff(at, append=len(term)).astype(np.int32), doc[at], term[at]
        n = np.bincount(word, minlength=len(names))
        total = np.bincount(term, minlength=len(names))
        first = np.cumsum(n) - n
        top, low = (f.reduceat(x, first) if len(n) else x for f, x in ((np.maximum, tf), (np.minimum, size[who])))
        ids = pa.array(docs, kind).take(pa.array(np.concatenate([np.arange(len(docs)), who])))
        lists = [_lists(np.append(len(docs), n), ids), _lists(np.append(0, n), pa.array(tf)), _lists(np.append(len(docs), n), pa.array(np.concatenate([size, size[who]]))), _lists(np.append(0, total), pa.array(pos))]
        numbers = [pa.array(np.append(x, y), pa.int32()) for x, y in ((len(docs), n), (0, top), (0, low), (0, total))]
        return pa.RecordBatch.from_arrays([pa.array([None, *names], pa.string()), pa.array(np.full(len(n) + 1, block), pa.int64()), *lists, *numbers], names=["term", "block", "docs", "tf", "len", "pos", "n", "max_tf", "min_len", "total"])

    def run(it):
        find, now, docs, tokens = re.compile(r"[^\W_]+").findall, None, [], []
        names: defaultdict = defaultdict()
        names.default_factory = names.__len__
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for block, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block != now and docs:
                        yield rows(now, docs, tokens, names)
                        docs, tokens = [], []
                        names.clear()
                    now, found = block, find(text or "")
                    docs.append(doc)
                    tokens.append(np.fromiter(map(names.__getitem__, found), np.int32, len(found)))
        if docs:
            yield rows(now, docs, tokens, names)

    return run


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))


def _made(docs: DataFrame, n_blocks: int, n: int) -> DataFrame:
    """Index rows of ``docs(doc_id, text)``, which are of ``n`` blocks; rows of a block meet in one task, in order of their ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = docs.limit(0).select("doc_id").toArrow().schema.field(0).type
    rows = docs.select(_block(n_blocks).alias("block"), "doc_id", T.index_text(F.col("text").cast("string")).alias("text"))
    tasks = max(min(docs.sparkSession.sparkContext.defaultParallelism, n), -(-n // TOGETHER), 1)
    rows = rows.repartition(tasks, "block").sortWithinPartitions("block", "doc_id")
    return rows.mapInArrow(_indexed(arrow), f"term string, block long, docs array<{kind}>, {_LISTS}")


def _laid(posts: DataFrame, n_blocks: int) -> DataFrame:
    """Postings as a compacted index has them: a folder's rows of FILE blocks in one task, ordered by term."""
    parts = -(-n_blocks // FILE)
    return posts.repartition(min(BUCKETS * parts, 4096), "bucket", F.pmod("block", F.lit(parts))).sortWithinPartitions("bucket", "term", "block")


def _put(change: Change, docs: DataFrame, n_blocks: int, rebuilt: DataFrame | None = None) -> None:
    """Write the rows of ``docs``, SLICE blocks after the other, as each task has made them.

    The blocks' own rows lie in a folder beside those of the terms, and are read back from there.
    """
    if rebuilt is not None:
        change.delete("postings", rebuilt).delete("members", rebuilt)
    n = n_blocks if rebuilt is None else rebuilt.count()
    slices = max(1, -(-n // SLICE))
    bucket = F.when(F.col("term").isNull(), F.lit(BUCKETS)).otherwise(_bucket(F.col("term")))
    for k in range(slices):
        some = docs.where(F.pmod(_block(n_blocks), F.lit(slices)) == k) if slices > 1 else docs
        posts = _made(some, n_blocks, -(-n // slices)).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "block")
        if rebuilt is None and not k:
            change.overwrite("postings", posts, ("bucket",))
        else:
            change.append("postings", posts)
    members = change.written("postings").where(F.col("bucket") == BUCKETS).select("block", "docs", "len")
    if rebuilt is None:
        change.overwrite("members", members).overwrite("shape", change.store.spark.createDataFrame([(n_blocks,)], "n_blocks long"))
    else:
        change.append("members", members)


def build(store: Store, docs: DataFrame, per_block: int = BLOCK) -> int:
    """Write the index of ``docs(doc_id, text)`` to ``store`` in one commit; returns the version. A null text has no terms."""
    n_blocks = max(1, -(-docs.count() // per_block))
    change = store.begin()
    _put(change, docs, n_blocks)
    return change.commit()


def refresh(store: Store, docs: DataFrame, touched: DataFrame) -> int:
    """Bring the index in step with ``docs`` after the rows ``touched(doc_id)`` were added, rewritten or deleted.

    Only the blocks of these are made anew, in one commit; all else keeps its files. If that is every block, the
    tables are written anew and no rows are left to be held against deletions.
    """
    change = store.begin().reads("postings", "members", "shape")
    n_blocks = change.base.read("shape").first()[0]
    block = _block(n_blocks).alias("block")
    blocks = materialised(touched.select(block).distinct())
    again = docs.withColumn("block", block).join(sized(blocks), "block", "left_semi").select("doc_id", "text")
    _put(change, again, n_blocks, blocks if blocks.count() < n_blocks else None)
    return change.commit()


def compact(store: Store) -> int:
    """Merge the postings and what was deleted of them into files of FILE blocks; if nothing was deleted, they are left as they are. Returns the version."""
    now = store.snapshot()
    if not any(p.keys for p in now.tables["postings"].pieces):
        return now.version
    n_blocks = now.read("shape").first()[0]
    return store.compact("postings", lambda posts: _laid(posts, n_blocks))


def statistics(snapshot: Snapshot) -> DataFrame:
    """(term, df, tf): documents that have a term, and its occurrences, off the index; no list is read."""
    return snapshot.read("postings").where(F.col("bucket") < BUCKETS).groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("tf"))


_UNIT = "unit string, block long, docs array<{}>, tf array<int>, len array<int>, n int, max_tf int, min_len int"


def _together(it, key: list[str], made):
    """Arrow batches in order of ``key`` -> ``made(*key, parts)`` for each run of rows with equal keys."""
    now, parts = None, []
    for batch in it:
        keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
        at = 0
        while at < len(keys):
            end = bisect_right(keys, keys[at], at)
            if keys[at] != now and parts:
                yield from made(*now, parts)
                parts = []
            now = keys[at]
            parts.append(batch.slice(at, end - at))
            at = end
    if parts:
        yield from made(*now, parts)


def _units(unit: pa.Array, block: int, n: np.ndarray, docs: pa.Array, tf: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows of one block: ``n`` documents a unit, of whose lists the ends are laid one after the other."""
    first = np.cumsum(n) - n
    lists = [_lists(n, docs), _lists(n, pa.array(tf, pa.int32())), _lists(n, pa.array(size, pa.int32()))]
    bounds = [pa.array(x, pa.int32()) for x in (n, np.maximum.reduceat(tf, first), np.minimum.reduceat(size, first))]
    return pa.RecordBatch.from_arrays([unit, pa.array(np.full(len(n), block), pa.int64()), *lists, *bounds], names=["unit", "block", "docs", "tf", "len", "n", "max_tf", "min_len"])


def _flat(parts: list, *names: str) -> list:
    return [pa.concat_arrays([p.column(c) for p in parts]) for c in names]


def _phrases(it):
    """(unit, block, slot, slots, docs, tf, len, pos) in order of unit and block -> one row each: where the terms follow each other."""

    def made(unit, block, parts):
        docs, tf, size, pos, slot, slots = _flat(parts, "docs", "tf", "len", "pos", "slot", "slots")
        if len(slot) < slots[0].as_py():
            return
        n, often = pc.list_value_length(docs).to_numpy(), tf.flatten().to_numpy()
        every, at, where = np.unique(_of(docs.flatten()), return_index=True, return_inverse=True)
        begins = np.repeat(where, often).astype(np.int64) << 32  # a place is a document and a token's number
        begins += pos.flatten().to_numpy() - np.repeat(np.repeat(slot.to_numpy(), n), often)
        ends = np.cumsum([often[b - k : b].sum() for b, k in zip(np.cumsum(n), n, strict=True)])
        kept = None
        for one in sorted(np.split(begins, ends[:-1]), key=len):
            kept = one if kept is None else np.intersect1d(kept, one, assume_unique=True)
        doc, f = np.unique(kept >> 32, return_counts=True)  # a begin before its text is in no first slot
        if len(doc):
            yield _units(pa.array([unit]), block, np.array([len(doc)]), pa.array(every[doc].tolist(), docs.type.value_type), f, size.flatten().to_numpy()[at[doc]])

    return _together(it, ["unit", "block"], made)


def _begun(it):
    """(block, docs, tf, len, units) -> rows of the same kind, one for each unit and block of a batch: what lies together is summed up before it travels."""
    for batch in it:
        for made in _prefixed(iter([batch.take(pc.sort_indices(batch.column("block")))])):
            units = pa.ListArray.from_arrays(pa.array(np.arange(made.num_rows + 1), pa.int32()), made.column("unit"))
            yield pa.RecordBatch.from_arrays([*(made.column(c) for c in ("block", "docs", "tf", "len")), units], names=["block", "docs", "tf", "len", "units"])


def _prefixed(it):
    """(block, docs, tf, len, units) in order of block -> a row for each unit and block: documents with any of its terms, and how often they have them."""

    def made(block, parts):
        docs, tf, size, units = _flat(parts, "docs", "tf", "len", "units")
        n, many = (pc.list_value_length(x).to_numpy() for x in (docs, units))
        names = units.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(n)), many)  # of each pair of a term and a unit
        times = n[row].astype(np.int64)
        entry = np.repeat((np.cumsum(n) - n)[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        every, where = np.unique(_of(docs.flatten()), return_inverse=True)
        pair = np.repeat(names.indices.to_numpy().astype(np.int64), times) * len(every) + where[entry]
        key, at, back = np.unique(pair, return_index=True, return_inverse=True)
        f = np.bincount(back, weights=tf.flatten().to_numpy()[entry]).astype(np.int64)
        found = every[key % len(every)]
        ids = pa.array(found if found.dtype != object else found.tolist(), docs.type.value_type)
        yield _units(names.dictionary, block, np.bincount(key // len(every)), ids, f, size.flatten().to_numpy()[entry[at]])

    return _together(it, ["block"], made)


def _scored(mean: float, k: int, scoped: bool):
    """(g, block, docs, tf, len, asking, groups) in order of g and block -> each task's k best of a question.

    ``asking`` holds the questions and weights of a row's term; a row without has the block's documents and
    their groups. A block's scores are one product: questions by terms times terms by documents.
    """

    def run(it):
        best: dict = {}
        kinds: list = []

        def block(_g, _block, parts):
            docs, tf, sizes, asking, groups = _flat(parts, "docs", "tf", "len", "asking", "groups")
            asked, of = asking.is_valid(), {}
            if asked.false_count:
                own = pc.invert(asked)
                of = dict(zip(_of(docs.filter(own).flatten()).tolist(), groups.filter(own).flatten().to_pylist(), strict=True))
                docs, tf, sizes, asking = (x.filter(asked) for x in (docs, tf, sizes, asking))
            asks = asking.flatten()
            kinds[:] = asks.type.field("query_id").type, docs.type.value_type
            if not len(asks):
                return ()
            n, many = (pc.list_value_length(x).to_numpy() for x in (docs, asking))
            often, long = (x.flatten().to_numpy().astype(np.float64) for x in (tf, sizes))
            part = often * (K1 + 1) / (often + K1 * (1 - B + B * long / mean))
            every, where = np.unique(_of(docs.flatten()), return_inverse=True)
            names = asks.field("query_id").dictionary_encode()
            q, names, weight = names.indices.to_numpy(), names.dictionary.to_pylist(), asks.field("weight").to_numpy()
            begins, asked_from = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(many))
            score = np.zeros((len(names), len(every)))
            for at in range(0, len(n), TERMS):
                end = min(at + TERMS, len(n))
                e, a, m = slice(begins[at], begins[end]), slice(asked_from[at], asked_from[end]), end - at
                parts_of = np.zeros((m, len(every)))
                parts_of[np.repeat(np.arange(m), n[at:end]), where[e]] = part[e]
                weights = np.bincount(q[a] * np.int64(m) + np.repeat(np.arange(m), many[at:end]), weights=weight[a], minlength=len(names) * m)
                score += weights.reshape(len(names), m) @ parts_of
            if scoped:
                group, codes = dict(zip(q.tolist(), asks.field("group").to_pylist(), strict=True)), {}
                code = lambda g: codes.setdefault(g, len(codes))
                held_in = np.array([code(of.get(d)) for d in every.tolist()])
                score *= np.array([code(group[i]) for i in range(len(names))])[:, None] == held_in[None]
            value = np.round(score, 6)
            floor = np.array([h[0][-1] if (h := best.get(x)) is not None and len(h[0]) == k else 0.0 for x in names])
            if len(every) > k:
                floor = np.maximum(floor, np.partition(value, len(every) - k, axis=1)[:, len(every) - k])
            live = (score > 0) & (value >= floor[:, None])
            for i in np.flatnonzero(live.any(1)).tolist():
                found, held = np.flatnonzero(live[i]), best.get(names[i])
                values, ids = value[i, found], every[found]
                if held is not None:
                    values, ids = np.concatenate([held[0], values]), np.concatenate([held[1], ids])
                order = np.lexsort((ids, -values))[:k]
                best[names[i]] = values[order], ids[order]
            return ()

        yield from _together(it, ["g", "block"], block)
        if best:
            who = [q for q, (v, _) in best.items() for _ in v]
            yield pa.RecordBatch.from_arrays([pa.array(who, kinds[0]), pa.array([d for _, ds in best.values() for d in ds.tolist()], kinds[1]), pa.array(np.concatenate([v for v, _ in best.values()]))], names=["query_id", "doc_id", "score"])

    return run


def _units_of(snapshot: Snapshot, units: DataFrame, prefix: bool) -> DataFrame:
    """(unit, block, docs, tf, len, n, max_tf, min_len) of the asked ``units(unit)``; only their terms' folders are read."""
    need = units.select("unit", F.lit(0).alias("slot"), F.col("unit").alias("term")) if prefix else units.select("unit", F.posexplode(F.split("unit", " ")).alias("slot", "term"))
    need = materialised(need.withColumn("slots", F.lit(1) if prefix else F.size(F.split("unit", " "))))
    posts = snapshot.read("postings")
    if not prefix or need.where(F.length("term") < 2).isEmpty():  # a single letter begins terms of any folder
        buckets = sorted(r[0] for r in need.select(_bucket(F.col("term"))).distinct().collect())  # BUCKETS at most
        posts = posts.where(F.col("bucket").isin(buckets))
    docs = snapshot.schema("postings")["docs"].dataType
    kind = _UNIT.format(docs.elementType.simpleString())
    if prefix:
        # The units that begin a term are found where its rows lie: those of HEAD letters and more by their first HEAD.
        none = F.array().cast("array<string>")
        long = need.where(F.length("unit") >= HEAD).groupBy(F.left("unit", F.lit(HEAD)).alias("head")).agg(F.collect_list("unit").alias("long"))
        rows = posts.where(F.col("bucket") < BUCKETS).join(sized(long), F.left("term", F.lit(HEAD)) == F.col("head"), "left")
        begins = [F.coalesce(F.filter("long", lambda u: F.startswith(F.col("term"), u)), none)]
        for n in range(1, HEAD):
            short = need.where(F.length("unit") == n).select(F.col("unit").alias(f"of{n}"))
            rows = rows.join(sized(short), F.left("term", F.lit(n)) == F.col(f"of{n}"), "left")
            begins.append(F.when(F.col(f"of{n}").isNull(), none).otherwise(F.array(f"of{n}")))
        rows = rows.select("block", "docs", "tf", "len", F.concat(*begins).alias("units")).where(F.size("units") > 0)
        rows = rows.mapInArrow(_begun, f"block long, docs {docs.simpleString()}, tf array<int>, len array<int>, units array<string>")
        return materialised(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_prefixed, kind))
    single = sized(need.where("slots = 1").select("unit", "term"))
    many = posts.join(single, "term").select("unit", "block", "docs", "tf", "len", "n", "max_tf", "min_len")
    need = need.where("slots > 1")
    if need.isEmpty():
        return many
    rows = posts.join(sized(need), "term").select("unit", "block", "slot", "slots", "docs", "tf", "len", "pos")
    rows = rows.repartition("unit", "block").sortWithinPartitions("unit", "block")
    return many.unionByName(materialised(rows.mapInArrow(_phrases, kind)))


def search(snapshot: Snapshot, asked: DataFrame, k: int, prefix: bool = False, scope: DataFrame | None = None, prune_from: int = PRUNE_FROM) -> DataFrame:
    """(query_id, doc_id, score, rnk): the k best documents of each question of ``asked(query_id, unit)``.

    A unit is one token, or several that have to follow each other (separated by one space); with ``prefix`` it is
    one token that stands for all that begin with it. A unit asked twice counts twice. Statistics
    span the whole index. With ``scope(doc_id, group)`` and a column ``group`` of ``asked`` only documents of
    the question's group are ranked. Scores are rounded to six digits, ties go to the smaller doc_id.
    """
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {snapshot.schema('postings')['docs'].dataType.elementType.simpleString()}, score double"
    group = F.col("group").cast("string") if scope is not None else F.lit(None).cast("string")
    asked = materialised(asked.where("unit <> ''").groupBy("query_id", group.alias("group"), "unit").agg(F.count("*").alias("times")))
    size = snapshot.read("members").agg(F.sum(F.size("docs")).alias("n"), F.sum(F.aggregate("len", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"), F.count("*").alias("blocks")).first()
    if k < 1 or not size.n or asked.isEmpty():
        return ranked(snapshot.store.spark.createDataFrame([], schema), "score", "doc_id", k)
    n, mean, n_asked = size.n, (size.tokens / size.n) or 1.0, asked.select("query_id").distinct().count()
    n_sides = -(-n_asked // SIDE)
    units = _units_of(snapshot, asked.select("unit").distinct(), prefix)
    facts = materialised(units.groupBy("unit").agg(F.sum("n").alias("df")))
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * F.col("times")
    side = F.pmod(F.xxhash64("query_id"), F.lit(n_sides)).alias("g")
    weighed = materialised(asked.join(sized(facts), "unit").select("unit", "df", side, "query_id", "group", weight.alias("weight")))

    def best(weighed: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        asking = weighed.groupBy("unit", "g").agg(F.collect_list(F.struct("query_id", "weight", "group")).alias("asking"))  # SIDE questions at most
        rows = units.join(sized(asking), "unit").select("g", "block", "docs", "tf", "len", "asking", F.lit(None).cast("array<string>").alias("groups"))
        if scope is not None:
            n_blocks = snapshot.read("shape").first()[0]
            own = scope.groupBy(_block(n_blocks).alias("block")).agg(F.collect_list(F.struct("doc_id", F.col("group").cast("string").alias("group"))).alias("m"))
            none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("tf", "len", "asking")]
            rows = rows.union(own.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sides - 1).cast("long"))).alias("g"), "block", F.col("m.doc_id").alias("docs"), *none, F.col("m.group").alias("groups")))
        if blocks is not None:
            rows = rows.join(sized(blocks), ["g", "block"], "left_semi").select(*rows.columns)
        tasks = max(int(snapshot.store.spark.conf.get("spark.sql.shuffle.partitions")), -(-n_sides * size.blocks // 8))
        rows = rows.repartition(min(tasks, n_sides * size.blocks, 4096), "g", "block").sortWithinPartitions("g", "block")
        return ranked(rows.mapInArrow(_scored(mean, k, scope is not None), schema), "score", "doc_id", k)

    # A short prefix is in nearly every document, and of many questions one or another reaches nearly every block.
    if prefix or size.blocks < prune_from or n_asked > PRUNE_ASKED:
        return best(weighed)
    first = materialised(best(weighed.where(F.col("df") <= n / RARE)))
    floor = first.where(F.col("rnk") == k).select("query_id", F.col("score").alias("floor"))
    most = F.col("weight") * F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_len") / mean))
    reach = units.select("unit", "block", "max_tf", "min_len").join(sized(weighed), "unit").groupBy("query_id", "g", "block").agg(F.sum(most).alias("reach"))
    open_ = reach.join(sized(floor), "query_id", "left").where(F.col("floor").isNull() | (F.col("reach") + 1e-5 >= F.col("floor")))
    return best(weighed, materialised(open_.select("g", "block").distinct()))
