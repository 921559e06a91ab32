"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, local_components, shuffle_partitions, sized, slices, tasks_for

SHINGLE = 4
MAX_BITS = 4
#: (shift, width): with at most 4 differing bits, one of three segments differs by at most one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: A bucket of more distinct fingerprints than this goes the way of midpoints.
DENSE = 1024


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle of whole ``text`` in order; fewer words make one, no word none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    out, one = np.empty(len(starts), np.uint64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65536):
        a, b = starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist()
        out[at : at + len(a)] = [one(norm[i:j], 42) for i, j in zip(a, b, strict=True)]
    return out


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of whole ``text``; 0 if it has no word."""
    found, ones = shingle_hashes(text, size), np.zeros(64, np.int64)
    for at in range(0, len(found), 255):  # counts of 255 rows fit a byte
        rows = found[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(rows, axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")


def _fingerprint_batches(it):
    for batch in slices(it):
        prints = np.fromiter((simhash(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long), one row for each row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): 64 rows a fingerprint, each a segment with one bit struck out; the key names segment and bit."""
    keys = []
    for shift, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append((segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))) + F.lit((shift + bit) << 22)).cast("int"))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _columns(it) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in it if b.num_rows]
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, prints = zip(*got, strict=True)
    return np.concatenate(keys), np.concatenate(prints)


def _as_edges(a: np.ndarray, b: np.ndarray):
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])


def _bucket_edges(it):
    """Of one partition of (key, fp): a spanning forest of the verified links within its buckets."""
    keys, prints = _columns(it)
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    at, a, b, held, lag = np.arange(len(keys)), [], [], 0, 0
    while len(at):
        lag += 1
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        near = at[np.bitwise_count((prints[at] ^ prints[at + lag]).view(np.uint64)) <= MAX_BITS]
        if len(near):
            a.append(prints[near])
            b.append(prints[near + lag])
            if (held := held + len(near)) > 500_000:
                x, y = local_components(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
    if a:
        yield from _as_edges(*local_components(np.concatenate(a), np.concatenate(b)))


def _midpoint_masks() -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([[np.uint64(0)], one, one[i] | one[j]])


def _midpoints(it):
    """(hub, fp) for each hub within 2 bits: two fingerprints are within 4 bits just if they share one."""
    masks = _midpoint_masks()
    for batch in it:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for fp in prints:
            hubs = (masks ^ fp).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(np.full(len(hubs), fp).view(np.int64))], names=["key", "fp"])


def _hub_edges(it):
    """Link each fingerprint to the first at its hub; a hub has at most 2,081."""
    keys, prints = _columns(it)
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = prints[np.flatnonzero(new)[np.cumsum(new) - 1]]
    linked = first != prints
    if linked.any():
        yield from _as_edges(*local_components(first[linked], prints[linked]))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``prints(fp)`` that connect just what is linked at MAX_BITS or fewer.

    Candidates come from an equality exchange on the one-wildcard segment variants and are verified.
    Each partition gives a spanning forest of its links, never all pairs of a group. Buckets beyond
    DENSE distinct fingerprints, which all-pairs work would make quadratic, are replaced by midpoint
    hubs: exact as well, and linear in the bucket.
    """
    spark, edges = prints.sparkSession, "a long, b long"
    keyed = variants(prints)
    n = prints.count()
    dense = checkpointed(keyed.groupBy("key").count().where(F.col("count") > DENSE).select("key"))
    found = None
    if not dense.isEmpty():
        crowded = keyed.join(dense, "key", "left_semi").select("fp").distinct()
        crowded = checkpointed(crowded)
        hubs = crowded.mapInArrow(_midpoints, "key long, fp long").repartition(tasks_for(spark, 2081 * crowded.count(), 1_000_000), "key")
        found = hubs.mapInArrow(_hub_edges, edges)
        keyed = keyed.join(dense, "key", "left_anti")
    dealt = keyed.select("key", "fp").repartition(tasks_for(spark, 64 * n, 1_000_000), "key")
    sparse = dealt.mapInArrow(_bucket_edges, edges)
    return sparse if found is None else sparse.union(found)


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Words are lower-cased (A-Z) runs of non-white-space; shingles have four of them, repeats count.
    Fewer words make one shingle; none (null and empty text too) gives fingerprint zero, linked like
    any other. Links join fingerprints within four bits; component_id is the smallest doc_id
    reachable. Null doc_ids are never the smallest: a component of nulls only has a null id. Rows
    with equal doc_id are rows of their own; a bit set in just half the shingles is 0. A very long text
    is hashed whole, 65,536 shingles at a time. An empty table gives no rows; other columns are ignored.
    """
    each = checkpointed(fingerprints(docs))
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = checkpointed(distinct.repartition(shuffle_partitions(docs.sparkSession), "fp"))  # the variants' work is dealt by these
    roots = connected_components(links(distinct.select("fp")))
    linked = checkpointed(distinct.join(roots.union(roots.select("root", "root").distinct()), distinct.fp == F.col("node")).select("fp", "least", "root"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(sized(ids, ids.count()), "root").select("fp", "component_id")
    classes = classes.union(distinct.join(linked, "fp", "left_anti").select("fp", "least"))
    return each.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def standing_rows(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least ``first`` (none, doc_id, hash of the text) of a root in ``of(first, root)``."""
    chosen = of.groupBy("root").agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.doc_id").alias("id"), F.col("first.mark").alias("mark")).distinct()
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["id"]) & (mark == chosen["mark"]), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = kept.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"), F.xxhash64(F.to_json(row)).alias("order"), row.alias("row"))
    if held.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        return kept
    return held.groupBy("doc_id", "mark").agg(F.min_by("row", "order").alias("row")).select("row.*")
