"""Removal of repeated byte strings: a depth-limited radix sort of all suffixes.

Two texts share a string of DEPTH bytes just where two suffixes agree through DEPTH bytes, so suffixes
are ordered no further than that, by most-significant-digit passes. Suffixes can't be dealt out by
their leading bytes without sending DEPTH bytes for each, so they are dealt by content first:

* every suffix (a window of DEPTH bytes) goes to a bin by the first of the GRAM-byte strings in it, in
  an order of hashes that puts common grams last. Neighbouring windows mostly share it, so runs of them
  travel as one string, compressed. Windows of nothing but common grams would make a bin large: those
  of the most frequent ones are dealt one by one, by a hash of all their bytes. Which grams are common
  is told by a bounded sample; every window has one place either way, so the result doesn't depend on it;
* within a bin, the suffixes are ordered by their bytes: by the first eight, then, only those still
  tied, by as many of the following as fit a number beside the group's, until DEPTH.

Equal groups at the end are exactly the repeated windows. The same passes run inside each chunk of the
input first: a window that a smaller document of the chunk has is settled there, so that a hot passage
reaches a bin once a chunk and not once a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, least_hashed, tasks_for

DEPTH = 50
GRAM = 8
#: Bytes of text ordered at once before the exchange, and aimed at in each bin after it.
CHUNK_BYTES = 1_000_000
#: Chunks whose runs for a bin travel together.
CHUNKS_A_BLOB = 8
BIN_BYTES = 4_000_000
#: A gram is dealt one by one from so many bins' share of a sample's windows on.
BINS_SHARE = 3
#: A task takes bins of about so many bytes in all; a bin of more than MOST_BYTES is ordered in several turns.
TASK_BYTES, MOST_BYTES = 64_000_000, 16_000_000
#: The zstandard dictionary of what travels: raw content, from the sample.
DICTIONARY_BYTES = 110_000
#: The sample that tells frequent grams: documents (least hash) and bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 2_000_000
#: Stands for a null doc_id: larger than all others, so it never takes a string from a document with an id.
NO_ID = (1 << 63) - 1

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, so that numbers order as bytes do."""
    return np.ndarray((len(buf) - 7,), ">u8", np.ascontiguousarray(buf), 0, (1,)).astype(np.uint64)


def _maybe_repeated(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` without the windows that are alone in their cell of a table of hashes: those can't be repeated."""
    bits = max(8, len(at).bit_length() + 1)
    h = words[at] * _A
    h ^= words[at + (DEPTH - 8) // 2] * _B
    h += words[at + DEPTH - 8]
    h *= _A
    cell = (h >> np.uint64(64 - bits)).astype(np.int32)
    last, own = np.empty(1 << bits, np.int32), np.arange(len(at), dtype=np.int32)
    last[cell] = own
    shared = np.zeros(1 << bits, bool)
    shared[cell[last[cell] != own]] = True
    return at[shared[cell]]


#: Grams fall into so many cells; a cell is common from so many times its share of a sample on.
CELLS, COMMON = 1 << 16, 8


def _hashed(words: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    return _mixed(words * _A * _B)


def _grams(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rank of the gram at each position: its hash, behind all others if its cell is ``common``."""
    h = _hashed(words)
    late = common[(h & np.uint64(CELLS - 1)).astype(np.uint16)].astype(np.uint64)
    h >>= np.uint64(1)
    h |= late << np.uint64(63)
    return h


def common_cells(texts: list[bytes]) -> np.ndarray:
    """Which cells of grams are common in ``texts``."""
    total = np.zeros(CELLS, np.int64)
    for text in texts:
        if len(text) >= GRAM:
            total += np.bincount((_hashed(_words(np.frombuffer(text, np.uint8))) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return total * CELLS > COMMON * max(int(total.sum()), CELLS)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


def _equal_groups(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group) of the windows among those starting ``at`` whose DEPTH bytes occur twice or more.

    Each pass orders what is tied by its next bytes. Groups that are equal through DEPTH already are
    told by comparing them with their first window, and need no further pass.
    """
    done, group, reach, found, at = 0, None, 0, [], _maybe_repeated(words, at)
    steps = (*range(0, DEPTH - 8, 8), DEPTH - 8)
    while len(at):
        if group is None:
            width, key = 8, words[at]
        else:
            width = min(DEPTH - reach, (64 - max(1, int(group[-1]).bit_length())) // 8)
            start = min(reach, DEPTH - 8)  # the number that holds the next bytes lies inside the window
            drop = np.uint64(8 * (8 - width - (reach - start)))
            key = group.astype(np.uint64) << np.uint64(8 * width)
            key |= (words[at + start] >> drop) & np.uint64((1 << 8 * width) - 1)
        reach += width
        order = np.argsort(key)
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        tied = np.zeros(len(key), bool)
        tied[1:] |= same
        tied[:-1] |= same
        first = np.concatenate([[True], ~same])[tied]
        at, group = at[tied], np.cumsum(first) - 1
        if not len(at):
            break
        if reach < 16:
            continue
        heads, equal = at[first][group], np.ones(len(at), bool)
        if reach < DEPTH:
            for s in steps[1:]:
                equal &= words[at + s] == words[heads + s]
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[~equal]] = True
        ended = ~mixed[group]
        if ended.any():
            found.append((at[ended], (np.cumsum(~mixed) - 1)[group[ended]] + done))
            done += int((~mixed).sum())
        at, group = at[~ended], (np.cumsum(mixed) - 1)[group[~ended]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _later(words, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Those of the windows ``at`` (ascending, of documents ``doc``) that a smaller document among them has too, ascending."""
    tied, group = _equal_groups(words, at)
    if not len(tied):
        return tied
    where = np.zeros(int(at[-1]) + 1, np.int64)
    where[at] = doc
    own = where[tied]
    least = np.full(int(group.max()) + 1, NO_ID)
    np.minimum.at(least, group, own)
    return np.sort(tied[own > least[group]])


def _whole(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of all bytes of the windows starting ``at``."""
    key = np.zeros(len(at), np.uint64)
    for offset in (*range(0, DEPTH - 8, 8), DEPTH - 8):
        key = _mixed(key * _A + words[at + offset])
    return key


def frequent_grams(texts: list[bytes], bins: int, common: np.ndarray) -> np.ndarray:
    """Ranks of the grams that BINS_SHARE bins' share of the different windows of ``texts`` are dealt by, ascending."""
    texts = [t for t in texts if len(t) >= DEPTH]
    if not texts:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    piece = np.repeat(np.arange(len(texts)), sizes)[: len(buf) - DEPTH + 1]
    at = np.flatnonzero(np.arange(len(piece)) + DEPTH <= np.cumsum(sizes)[piece])
    words = _words(buf)
    gone = _later(words, at, piece[at].astype(np.int64))
    grams, counts = np.unique(_least(_grams(words, common), DEPTH - GRAM + 1)[np.setdiff1d(at, gone, assume_unique=True)], return_counts=True)
    return grams[counts > BINS_SHARE * counts.sum() / bins] if bins > 1 else grams[:0]


def _runs(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive ``starts`` of one owner."""
    cut = np.flatnonzero((np.diff(starts) != 1) | (owner[1:] != owner[:-1]))
    return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(starts) - 1]])


def _pieces(offsets: np.ndarray):
    """Lists of (row, from, to): the bytes of a batch in chunks; a long text goes in pieces that share DEPTH - 1 bytes."""
    chunk, size = [], 0
    for row in range(len(offsets) - 1):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        while hi - lo >= DEPTH:
            to = min(hi, lo + CHUNK_BYTES)
            chunk.append((row, lo, to))
            if (size := size + to - lo) >= CHUNK_BYTES:
                yield chunk
                chunk, size = [], 0
            lo = hi if to == hi else to - DEPTH + 1
    if chunk:
        yield chunk


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: small ones compress to little more than those."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).reshape(-1).view(np.int64)


def _packing(content: bytes) -> dict:
    """Arguments for zstandard's two sides."""
    return {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(content) >= 8 else {}


def _cutter(bins: int, frequent: np.ndarray, common: np.ndarray, content: bytes = b""):
    """Batches of (doc_id, variant, text bytes) -> rows for bins: blobs of window runs, and spans already settled."""

    def cut(it):
        packer = zstandard.ZstdCompressor(level=3, **_packing(content))
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            variants = batch.column(1).to_numpy(zero_copy_only=False)
            text = batch.column(2)
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
            data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and len(text) else np.zeros(0, np.uint8)
            held: dict[int, list] = {}
            for number, chunk in enumerate(_pieces(offsets), 1):
                if number % CHUNKS_A_BLOB == 0:
                    yield _blobs(held, packer)
                buf = np.concatenate([data[lo:hi] for _, lo, hi in chunk])
                sizes = np.array([hi - lo for _, lo, hi in chunk])
                ends = np.cumsum(sizes)
                piece = np.repeat(np.arange(len(chunk), dtype=np.int32), sizes)[: len(buf) - DEPTH + 1]
                at = np.flatnonzero(np.arange(len(piece)) + DEPTH <= ends[piece])
                row = np.array([r for r, _, _ in chunk])[piece]
                shift = np.array([lo - offsets[r] for r, lo, _ in chunk]) - (ends - sizes)
                words = _words(buf)
                least = _least(_grams(words, common), DEPTH - GRAM + 1)
                gone = _later(words, at, ids[row[at]])
                if len(gone):
                    a, b = _runs(gone, piece[gone])
                    r, move = row[gone[a]], shift[piece[gone[a]]]
                    yield _rows(np.zeros(len(a), np.int64) + ids[r] % bins, ids[r], variants[r], gone[a] + move, gone[b] + move + DEPTH, None)
                    kept = np.ones(len(at), bool)
                    kept[np.searchsorted(at, gone)] = False
                    at = at[kept]
                if not len(at):
                    continue
                own_place = np.isin(least[at], frequent) if len(frequent) else np.zeros(len(at), bool)
                cuts = np.flatnonzero((np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (piece[at[1:]] != piece[at[:-1]]) | own_place[1:])
                a, b = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(at) - 1]])
                start, count = at[a], b - a + 1
                place = np.where(own_place[a], _whole(words, start), _mixed(least[start].copy())) if len(frequent) else _mixed(least[start].copy())
                home = (place % np.uint64(bins)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                start, count, home = start[order], count[order], home[order]
                r = row[start]
                own, kind, begin = ids[r], variants[r], start + shift[piece[start]]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(home)) + 1, [len(home)]])
                n = (count + DEPTH - 1).astype(np.int32)
                total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                taken = np.repeat((start - total[:-1]).astype(np.int32), n)
                taken += np.arange(total[-1], dtype=np.int32)
                body = buf[taken]
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    held.setdefault(int(home[i]), []).append((own[i:j], kind[i:j], begin[i:j], count[i:j], body[total[i] : total[j]]))
            yield _blobs(held, packer)

    return cut


def _blobs(held: dict[int, list], packer):
    """A row for each bin of ``held``, which is emptied: its runs' documents, places and lengths, then their bytes."""
    bins, blobs = sorted(held), []
    for home in bins:
        own, kind, begin, count, body = (np.concatenate(x) for x in zip(*held.pop(home), strict=True))
        head = b"".join(_planes(x) for x in (np.diff(own, prepend=0), kind, begin, count))
        blobs.append(packer.compress(np.int64(len(own)).tobytes() + head + body.tobytes()))
    none = np.zeros(len(blobs), np.int64)
    return _rows(np.array(bins, np.int64), none, none, none, none, blobs)


def _rows(home, ids, variants, lo, hi, blobs):
    columns = [pa.array(np.asarray(x, np.int64)) for x in (home, ids, variants, lo, hi)]
    columns.append(pa.nulls(len(home), pa.binary()) if blobs is None else pa.array(blobs, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bin", "doc_id", "variant", "lo", "hi", "blob"])


def _bin_later(buf: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``_later`` of a whole bin; a large one in turns, each of the windows with certain first bytes."""
    words, turns = _words(buf), -(-len(buf) // MOST_BYTES)
    if turns == 1:
        return _later(words, at, doc)
    turn = np.concatenate([(_mixed(words[at[k : k + MOST_BYTES]]) % np.uint64(turns)).astype(np.int32) for k in range(0, len(at), MOST_BYTES)])
    return np.sort(np.concatenate([_later(words, at[own], doc[own]) for own in (turn == k for k in range(turns))]))


def _binned(content: bytes):
    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        """Of one bin: the spans that came settled, and those of windows that a smaller document has."""
        settled = rows[rows.blob.isnull()][["doc_id", "variant", "lo", "hi"]]
        unpacker, heads, bodies = zstandard.ZstdDecompressor(**_packing(content)), [], []
        for blob in rows.blob.dropna():
            raw = unpacker.decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            head = np.stack([_numbers(raw, n, 8 + 8 * n * k) for k in range(4)])
            head[0] = np.cumsum(head[0])
            heads.append(head)
            bodies.append(np.frombuffer(raw, np.uint8, offset=8 + 32 * n))
        if not heads:
            return settled
        own, kind, begin, count = np.concatenate(heads, axis=1)
        buf = np.concatenate(bodies)
        n = count + DEPTH - 1
        total = np.cumsum(n)
        unit = np.repeat(np.arange(len(n), dtype=np.int32), count)
        at = np.arange(len(unit)) + unit * np.int64(DEPTH - 1)
        gone = _bin_later(buf, at, own[unit])
        if not len(gone):
            return settled
        unit = unit[np.searchsorted(at, gone)]
        a, b = _runs(gone, unit)
        u = unit[a]
        move = begin[u] - (total - n)[u]
        found = pd.DataFrame({"doc_id": own[u], "variant": kind[u], "lo": gone[a] + move, "hi": gone[b] + move + DEPTH})
        return pd.concat([settled, found], ignore_index=True)

    return spans


def _packed(content: bytes):
    """(doc_id, key, kind, raw) -> the same with compressed bytes."""

    def run(it):
        packer = zstandard.ZstdCompressor(level=3, **_packing(content))
        for batch in it:
            raw = [packer.compress(memoryview(x.as_buffer())) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["doc_id", "key", "kind", "packed"])

    return run


def _finisher(content: bytes):
    """(doc_id, packed, lo, hi) -> the removed runs' figures and the hash of what is left."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def figures(unpacker, batch):
        for text, lo, hi in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
            text, lo, hi = memoryview(unpacker.decompress(text.as_buffer())), lo.values, hi.values
            digest, at, removed, spans = hashlib.sha256(), 0, 0, 0
            if lo is not None and len(lo):
                lo, hi = lo.to_numpy(), hi.to_numpy()
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                cut = np.flatnonzero(lo[1:] > reach[:-1])
                for a, b in zip(lo[np.concatenate([[0], cut + 1])].tolist(), reach[np.concatenate([cut, [len(lo) - 1]])].tolist(), strict=True):
                    digest.update(text[at:a])
                    at, removed, spans = b, removed + b - a, spans + 1
            digest.update(text[at:])
            yield len(text), removed, spans, digest.hexdigest()

    def run(it):
        unpacker = zstandard.ZstdDecompressor(**_packing(content))
        for batch in it:
            columns = list(zip(*figures(unpacker, batch), strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return run


def sampled(docs: DataFrame) -> list[bytes]:
    """Texts of SAMPLE_ROWS documents (least hash; pieces of longer ones), SAMPLE_BYTES of them at most."""
    some = least_hashed(docs.select("doc_id", F.substring("raw", 1, SAMPLE_BYTES // 100).alias("raw")), "doc_id", SAMPLE_ROWS, "raw").collect()
    sizes = np.cumsum([len(r.raw) for r in some])
    return [bytes(r.raw) for r, n in zip(some, sizes, strict=True) if n <= SAMPLE_BYTES]


def repeated_spans(docs: DataFrame, total_bytes: int, texts: list[bytes], content: bytes) -> DataFrame:
    """(doc_id, variant, lo, hi): byte ranges of ``docs(doc_id, variant, raw)`` to remove; they may overlap."""
    carried, common = int(3.3 * total_bytes), common_cells(texts)
    bins = max(1, -(-carried // BIN_BYTES))
    schema = "bin long, doc_id long, variant long, lo long, hi long, blob binary"
    dealt = docs.select("doc_id", "variant", "raw").mapInArrow(_cutter(bins, frequent_grams(texts, bins, common), common, content), schema)
    dealt = dealt.repartition(tasks_for(docs.sparkSession, carried, TASK_BYTES), "bin")
    return dealt.groupBy("bin").applyInPandas(_binned(content), "doc_id long, variant long, lo long, hi long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs(doc_id, text)``.

    Each byte covered by a DEPTH-byte string that also starts in a document with a smaller doc_id is
    removed; strings are judged on the input. Null texts are empty. Rows that share a doc_id are one
    document as to order: they never take strings from each other, and each keeps its own row. A null
    doc_id counts as larger than every other. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    repeated = not rows.groupBy("key").count().where("count > 1").isEmpty()
    variant = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    rows = rows.withColumn("variant", variant)
    raw = rows.select(F.col("key").alias("doc_id"), "variant", F.col("text").cast("binary").alias("raw"))
    texts = sampled(raw)
    content = b"\n".join(texts)[:DICTIONARY_BYTES]
    spans = repeated_spans(raw, size, texts, content)
    spans = checkpointed(spans.distinct() if repeated else spans)
    spans = spans.groupBy("doc_id", "variant").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    packed = rows.select("doc_id", "key", "variant", F.col("text").cast("binary").alias("raw")).mapInArrow(_packed(content), "doc_id long, key long, kind long, packed binary")
    joined = packed.join(spans, (packed.key == spans.doc_id) & (packed.kind == spans.variant), "left")
    none = F.array().cast("array<bigint>")
    joined = joined.select(packed.doc_id, "packed", F.coalesce("lo", none).alias("lo"), F.coalesce("hi", none).alias("hi"))
    return joined.mapInArrow(_finisher(content), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
