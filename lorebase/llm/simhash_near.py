"""SimHash near-dedup at a similarity instead of a few bits: the pipeline's form of ``simhash``.

Texts are linked whose *sets* of five-word shingles have a Jaccard similarity of 0.8 or more. The
SimHashes of such sets differ in up to some 15 % of their bits, so the fingerprint is wide: 512 bits, of
which 24 segments of 20 are indexed by their one-wildcard variants. A pair at exactly 0.8 agrees in some
segment but for one bit with a probability of 0.99, one at 0.85 of 0.999; bits of the fingerprint, then
whole sets verify what meets, so no pair is linked that isn't similar.

Sets of up to SHORT shingles scatter too much for that. They, and all that can be similar to them, are also
joined exactly by prefix filter: shingles in order of rarity, of which similar sets share one of the first few.

A variant leaves one half of its segment alone. Texts are therefore dealt by the halves, 48 rows each,
and a task makes the variants of its bins itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, shuffle_partitions, sized, slices, tasks_for
from .simhash import shingle_hashes, standing_rows

SHINGLE = 5
#: Similarity as a fraction, so that comparisons are exact.
SIMILARITY = (4, 5)
#: 64-bit words of a fingerprint, segments of each, bits of a segment.
WORDS, CUTS, WIDTH = 8, 3, 20
HALF = WIDTH // 2
#: Most differing bits of the first word, and of all; 10 and 78 are the expected numbers at 0.8, 32 and 256 those of
#: unrelated sets. Small sets scatter more: SMALL_BITS of them more are allowed, divided by the smaller set's size.
FIRST_BITS, ALL_BITS, MORE_BITS, SMALL_BITS = 20, 104, 24, 400
#: Shingles up to which a set is also joined exactly.
SHORT = 16
#: Rounds of joining each component to what is nearest to it, at most, and texts that each is compared with at a variant.
ROUNDS, NEIGHBOURS = 6, 8
#: Rows of a bin that are handled together; a larger bin is dealt out as blocks and pairs of blocks.
CELL = 200_000
#: Pairs of one text that are verified in one place, and pairs made at once.
VERIFIED, AT_ONCE = 256, 250_000
#: In the last step texts with more than DENSE candidates are verified by groups of so many pairs, the others by groups of so many texts.
DENSE, GROUP_PAIRS, GROUP_TEXTS = 64, 50_000, 2_000

_SEEDS = np.random.default_rng(8).integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_PRINT = [f"w{k}" for k in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the five-word shingles of whole ``text``; fewer words make one, no word none."""
    return np.unique(shingle_hashes(text, SHINGLE)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are at SIMILARITY or more; two empty ones are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def wide_print(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes: WORDS numbers, a bit set if more than half of the shingles have it set."""
    ones, h = np.zeros(64 * WORDS, np.int64), found.view(np.uint64)
    for at in range(0, len(h), 255):  # counts of 255 rows fit a byte
        x = h[at : at + 255, None] * _SEEDS
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), 8 * WORDS), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h)).view(np.uint64)


def _sets(it):
    """(doc_id, text, mark) -> (doc_id, mark, sid, n, words of the fingerprint)."""
    for batch in slices(it):
        sids, sizes, prints = [], [], np.zeros((batch.num_rows, WORDS), np.uint64)
        for k, text in enumerate(batch.column(1)):
            found = shingles(text.as_py())
            sids.append(xxhash.xxh64_intdigest(found.tobytes()))
            sizes.append(len(found))
            prints[k] = wide_print(found)
        columns = [batch.column(0), batch.column(2), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
        columns += [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(WORDS)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "sid", "n", *_PRINT])


def _numpy(batch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _halves(prints: list[np.ndarray], cuts: int = CUTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, rest), 2 * WORDS * cuts columns: the half of a segment that names a bin, and its other half."""
    bins, rests = [], []
    for word in prints:
        word = word.view(np.uint64)
        for k in range(cuts):
            cut = (word >> np.uint64(WIDTH * k)) & np.uint64((1 << WIDTH) - 1)
            high, low = (cut >> np.uint64(HALF)).astype(np.int64), (cut & np.uint64((1 << HALF) - 1)).astype(np.int64)
            for own, other in ((high, low), (low, high)):
                bins.append(own + (len(bins) << HALF))
                rests.append(other)
    return np.stack(bins, axis=1), np.stack(rests, axis=1)


def _histogram(cuts: int):
    def run(it):
        """Rows of each bin."""
        total = np.zeros(2 * WORDS * cuts << HALF, np.int64)
        for batch in it:
            bins, _ = _halves(_numpy(batch), cuts)
            total += np.bincount(bins.reshape(-1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "c"])

    return run


def _dealer(blocks: dict[int, int], crossed: bool, cuts: int = CUTS):
    """(sid, n, comp, words) -> (place, rest, n, sid, comp, first word): a row for each half.

    Texts of a large bin are dealt to a block, or, if ``crossed``, to all pairs of blocks with theirs.
    """

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, 1024):
                sid, n, comp, *prints = _numpy(whole.slice(at, 1024))
                bins, rest = _halves(prints, cuts)
                row = np.repeat(np.arange(len(sid)), bins.shape[1])
                bins, rest = bins.reshape(-1), rest.reshape(-1)
                place = bins << 32  # bin, lesser and greater block
                if blocks:
                    count = np.ones(len(bins), np.int64)
                    for one, c in blocks.items():
                        count[bins == one] = c
                    own = (sid[row].view(np.uint64) % count.astype(np.uint64)).astype(np.int64)
                    if crossed:
                        each = np.repeat(np.arange(len(row)), count)
                        other = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                        row, rest, own = row[each], rest[each], own[each]
                        place = place[each] | np.minimum(own, other) << 16 | np.maximum(own, other)
                    else:
                        place = place | own << 16 | own
                    rest = rest | own << HALF
                columns = [place, rest, n[row], sid[row], comp[row], prints[0][row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "rest", "n", "sid", "comp", "near"])

    return run


def _gathered(it, order_by: int):
    """All rows of a partition as arrays, ordered by a column; None if there are none."""
    got = [_numpy(b) for b in it if b.num_rows]
    if not got:
        return None
    columns = [np.concatenate(c) for c in zip(*got, strict=True)]
    order = np.argsort(columns[order_by], kind="stable")
    return [c[order] for c in columns]


def _may(n, m, near, other) -> np.ndarray:
    """Whether sets of sizes n and m, with first words near and other, can be similar."""
    p, q = SIMILARITY
    return (q * n >= p * m) & (q * m >= p * n) & (np.bitwise_count((near ^ other).view(np.uint64)) <= FIRST_BITS)


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of lists of pairs, the smaller first, in order."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new]


def _lists(found: list[tuple[np.ndarray, np.ndarray]]):
    """The distinct pairs as a row for each smaller one, with the list of its partners."""
    a, b = _distinct(found)
    if len(a):
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(a)]]).astype(np.int32)), pa.array(b))
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), lists], names=["a", "bs"])


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]):
    a, b = _distinct(found)
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])


def _nearest(it):
    """Of one partition: for each row the text of another component that is nearest by the first word, of some at its variants."""
    got = _gathered(it, 3)
    if got is None:
        return
    place, rest, n, sid, comp, near = got
    rest = rest & (1 << HALF) - 1
    best = np.full(len(sid), np.iinfo(np.int64).max)
    for bit in range(HALF):
        key = place << HALF | rest & ~(1 << bit)
        order = np.argsort(key, kind="stable")
        key = key[order]
        for lag in range(1, NEIGHBOURS + 1):
            at = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(at):
                break
            x, y = order[at], order[at + lag]
            kept = (comp[x] != comp[y]) & _may(n[x], n[y], near[x], near[y])
            x, y = x[kept], y[kept]
            far = np.bitwise_count((near[x] ^ near[y]).view(np.uint64)).astype(np.int64) << 32
            best[x] = np.minimum(best[x], far | y)  # neither x nor y has a row twice
            best[y] = np.minimum(best[y], far | x)
    x = np.flatnonzero(best < np.iinfo(np.int64).max)
    y = best[x] & 0xFFFFFFFF
    yield from _pairs([(sid[x], sid[y])] if len(x) else [])


def _crossed(it):
    """Of one partition: (a, bs), all pairs at a variant that may be similar and aren't in one component yet."""
    got, found, held = _gathered(it, 4), [], 0
    if got is None:
        return
    place, rest, n, sid, comp, near = got
    block, rest = rest >> HALF, rest & (1 << HALF) - 1
    whole = (place >> 16 & 0xFFFF) == (place & 0xFFFF)
    for bit in range(HALF):
        key = place << HALF | rest & ~(1 << bit)
        order = np.argsort(key, kind="stable")  # rows of a component stay together
        k, c = key[order], comp[order]
        run = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.concatenate([run[1:], [len(k)]])
        last = np.repeat(ends, ends - run)
        part = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
        ends = np.concatenate([part[1:], [len(k)]])
        after = np.repeat(ends, ends - part)
        at = np.flatnonzero(last > after)
        sizes = (last - after)[at]
        steps = np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1
        for some, many in zip(np.split(at, steps), np.split(sizes, steps), strict=True):
            if not len(some):
                continue
            x = np.repeat(some, many)
            y = np.repeat(after[some] - (np.cumsum(many) - many), many) + np.arange(len(x))
            x, y = order[x], order[y]
            kept = _may(n[x], n[y], near[x], near[y]) & (whole[x] | (block[x] != block[y]))  # of two blocks only what lies across
            x, y = x[kept], y[kept]
            if len(x):
                found.append((sid[x], sid[y]))
                if (held := held + len(x)) > AT_ONCE:
                    yield from _lists(found)
                    found, held = [], 0
    yield from _lists(found)


def _with_components(distinct: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(sid, n, comp, words): a text's component is its own until it is linked."""
    if comps is None:
        return distinct.select("sid", "n", F.col("sid").alias("comp"), *_PRINT)
    return distinct.join(comps, distinct.sid == comps.node, "left").select("sid", "n", F.coalesce("root", "sid").alias("comp"), *_PRINT)


def _dealt(own: DataFrame, every: bool) -> DataFrame:
    """Rows for the bins of all segments, or of one a word."""
    spark, cuts, n, blocks = own.sparkSession, CUTS if every else 1, own.count(), {}
    if n > CELL:  # a bin has a row of each text at most
        counts = own.select(*_PRINT).repartition(-(-n // CELL)).mapInArrow(_histogram(cuts), "bin long, c long")
        counts = counts.groupBy("bin").agg(F.sum("c").alias("c")).where(F.col("c") > CELL)
        blocks = {r.bin: -(-r.c // CELL) for r in counts.collect()}  # 49,152 bins at most, however many texts
    dealt = own.mapInArrow(_dealer(blocks, every, cuts), "place long, rest long, n long, sid long, comp long, near long")
    return dealt.repartition(tasks_for(spark, 2 * WORDS * cuts * n, CELL), "place")


def _nearest_pairs(own: DataFrame) -> DataFrame:
    """(a, b): for each component the pair with another one that is nearest by all bits, of those that meet and may be similar."""
    pairs = _dealt(own, False).mapInArrow(_nearest, "a long, b long").distinct()
    side = lambda x: own.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"), *(F.col(w).alias(f"{x}{k}") for k, w in enumerate(_PRINT)))
    far = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS)), F.lit(0))
    most = ALL_BITS + F.least(F.lit(MORE_BITS), SMALL_BITS / F.least("na", "nb"))
    found = checkpointed(pairs.join(side("a"), "a").join(side("b"), "b").withColumn("far", far).where(F.col("far") <= most).select("a", "b", "ca", "cb", "far"))
    ends = found.select(F.col("ca").alias("c"), "far", "a", "b").union(found.select("cb", "far", "a", "b"))
    return checkpointed(ends.groupBy("c").agg(F.min(F.struct("far", "a", "b")).alias("e")).select("e.a", "e.b").distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()


def _texts(marked: DataFrame, distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text) of the texts ``wanted(sid)``; the others don't move if these are few enough to be broadcast."""
    wanted = checkpointed(distinct.join(wanted, "sid", "left_semi").select("sid", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_own")))
    both = marked.join(sized(wanted, wanted.count()), marked["doc_id"].eqNullSafe(wanted["_id"]) & (marked["mark"] == wanted["_own"]))
    return both.select("sid", "text").dropDuplicates(["sid"])


def _similar_pairs(it):
    """(a, b, text) in order: a's own text (b null), then those of its partners -> the pairs that are similar."""
    owner, found = None, None
    for batch in slices(it):
        kept = []
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if b is None:
                owner, found = a, shingles(text.as_py())
            kept.append(b is not None and a == owner and similar(found, shingles(text.as_py())))
        yield batch.select([0, 2]).filter(pa.array(kept, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones of ``pairs``. A text with many partners travels once for each VERIFIED of them."""
    spark = pairs.sparkSession
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFIED).alias("parts"))
    dealt = checkpointed(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b"))
    texts = checkpointed(texts)
    heads = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("sid")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    tails = dealt.join(texts, F.col("b") == F.col("sid")).select("a", "part", "b", "text")
    rows = heads.union(tails).repartition(tasks_for(spark, dealt.count(), 20_000), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return checkpointed(rows.mapInArrow(_similar_pairs, "a long, b long"))


def _members(it):
    """(q, a, bs), ordered by q: the texts of each q, once."""
    held, last = set(), None
    for batch in slices(it):
        for q, a, bs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if q != last and held:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), last)), pa.array(sorted(held))], names=["q", "sid"])
                held = set()
            last = q
            held.add(a)
            held.update(bs)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), last)), pa.array(sorted(held))], names=["q", "sid"])


class _Group:
    """The texts of one q, and which of them are linked so far."""

    def __init__(self):
        self.place, self.texts, self.sets, self.sizes, self.prints, self.comp, self.root = {}, [], {}, [], [], {}, {}

    def add(self, sid: int, text: str, n: int, comp: int, words: list[int]) -> None:
        self.place[sid] = len(self.texts)
        self.comp[sid] = comp
        self.texts.append(text)
        self.sizes.append(n)
        self.prints.append(words)

    def found(self, sid: int) -> np.ndarray:
        if sid not in self.sets:
            self.sets[sid] = shingles(self.texts[self.place[sid]])
        return self.sets[sid]

    def top(self, sid: int) -> int:
        comp = self.comp[sid]
        while (up := self.root.get(comp, comp)) != comp:
            self.root[comp] = self.root.get(up, up)
            comp = up
        return comp

    def links(self, a: int, bs: list[int]):
        """The similar ones of a's candidates that nothing links to it yet."""
        if isinstance(self.prints, list):
            self.prints, self.sizes = np.array(self.prints, np.int64).view(np.uint64), np.array(self.sizes, np.int64)
        at, own = np.array([self.place[b] for b in bs]), self.place[a]
        far = np.bitwise_count(self.prints[at] ^ self.prints[own]).sum(axis=1)
        for b in np.array(bs)[far <= ALL_BITS + np.minimum(MORE_BITS, SMALL_BITS / np.minimum(self.sizes[at], self.sizes[own]))].tolist():
            if self.top(a) != self.top(b) and similar(self.found(a), self.found(b)):
                self.root[self.top(b)] = self.top(a)
                yield b


def _verified_lists(it):
    """(q, sid, bs, n, comp, words, text), ordered by q, texts (bs null) before lists -> links that connect what is similar."""
    group, last = _Group(), None
    for batch in slices(it):
        a_out, b_out = [], []
        for q, sid, bs, n, comp, *words, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if q != last:
                group, last = _Group(), q
            if bs is None:
                group.add(sid, text, n, comp, words)
            else:
                for b in group.links(sid, bs):
                    a_out.append(sid)
                    b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _across(own: DataFrame, distinct: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is linked by similar pairs across components; all candidates are looked at.

    Candidates travel as lists; where a group's texts nearly all are candidates of each other, each text
    travels once for many pairs.
    """
    spark = own.sparkSession
    lists = _dealt(own, True).mapInArrow(_crossed, "a long, bs array<long>")
    lists = checkpointed(lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")))
    dense = F.size("bs") > DENSE
    size = lists.agg(F.sum(F.when(dense, F.size("bs"))).alias("pairs"), F.count_if(~dense).alias("texts")).first()
    groups, few = max(1, -(-(size.pairs or 0) // GROUP_PAIRS)), max(1, -(-(size.texts or 0) // GROUP_TEXTS))
    q = F.when(dense, F.pmod(F.xxhash64("a"), F.lit(groups)) * 2 + 1).otherwise(F.pmod(F.xxhash64("a"), F.lit(few)) * 2)
    lists = lists.select(q.cast("long").alias("q"), "a", "bs")
    members = lists.repartition(max(1, min(groups + few, tasks_for(spark, 0, 1))), "q").sortWithinPartitions("q")
    members = checkpointed(members.mapInArrow(_members, "q long, sid long"))
    texts = _texts(marked, distinct, members.select("sid").distinct()).join(own.select("sid", "n", "comp", *_PRINT), "sid")
    heads = members.join(texts, "sid").select("q", "sid", F.lit(None).cast("array<long>").alias("bs"), "n", "comp", *_PRINT, "text")
    none = [F.lit(None).cast("long").alias(c) for c in ("n", "comp", *_PRINT)]
    rows = heads.union(lists.select("q", "a", "bs", *none, F.lit(None).cast("string").alias("text")))
    rows = rows.repartition(tasks_for(spark, groups + few, 1), "q").sortWithinPartitions("q", F.col("bs").isNotNull())
    return checkpointed(rows.mapInArrow(_verified_lists, "a long, b long"))


def _grams(it):
    """(sid, text) -> (sid, grams), the set of each text."""
    for batch in slices(it):
        found = [shingles(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["sid", "grams"])


def _linked(sids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that connect what is similar among ``sets``, which share a shingle."""
    m, sizes = len(sids), np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order]) != 0]))
    at, ends = np.searchsorted(tokens[order][starts], tokens), np.append(starts[1:], len(owner))
    group, out, first = np.arange(m), [], np.concatenate([[0], np.cumsum(sizes)])
    for i in range(1, m):
        own = at[first[i] : first[i + 1]]
        both = np.bincount(np.concatenate([owner[starts[t] : ends[t]] for t in own]), minlength=m)[:i]
        near = np.flatnonzero(SIMILARITY[1] * both >= SIMILARITY[0] * (sizes[i] + sizes[:i] - both))
        for g in np.unique(group[near]):
            if g != group[i]:
                out.append((sids[int(near[group[near] == g][0])], sids[i]))
        if len(near):
            group[np.isin(group, np.append(group[near], group[i]))] = group[near].min()
    return out


def _alike(it):
    """(g, sid, grams) in order of g -> links between the similar sets of each g."""
    now, sids, sets, out = None, [], [], []

    def batch():
        a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for whole in it:
        for g, sid, grams in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), whole.column(2), strict=True):
            if g != now:
                if len(sids) > 1:
                    out += _linked(sids, sets)
                now, sids, sets = g, [], []
            sids.append(sid)
            sets.append(grams.values.to_numpy())
        if out:
            yield batch()
            out = []
    if len(sids) > 1 and (out := _linked(sids, sets)):
        yield batch()


def short_links(distinct: DataFrame, marked: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is similar among sets of up to SHORT shingles and those that can be similar to them, exactly.

    Of n shingles in order of rarity, two similar sets share one of the first n - ceil(0.8 n) + 1: these are
    dealt out, five rows a set at most, and whole sets compared where they meet.
    """
    p, q = SIMILARITY
    spark, most = distinct.sparkSession, SHORT * q // p
    sets = checkpointed(_texts(marked, distinct, distinct.where(F.col("n") <= most).select("sid")).mapInArrow(_grams, "sid long, grams array<long>"))
    each = sets.select("sid", F.explode("grams").alias("g"))
    ranked = each.join(each.groupBy("g").agg(F.count("*").alias("c")), "g").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("r"))  # a set's few
    n = F.size("r")
    tokens = ranked.select("sid", F.explode(F.slice("r", F.lit(1), n - F.ceil(n * p / q).cast("int") + 1)).alias("r")).where("r.c > 1").select(F.col("r.g").alias("g"), "sid")
    rows = tokens.join(sets, "sid").select("g", "sid", "grams").repartition(tasks_for(spark, 5 * sets.count(), CELL), "g").sortWithinPartitions("g", "sid")
    return checkpointed(rows.mapInArrow(_alike, "a long, b long").distinct())


def links(distinct: DataFrame, marked: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets ``distinct(sid, n, first, words)`` that connect what is linked by similar pairs.

    Short sets are joined first. In rounds, each component is compared with what looks nearest to it, so that a large group of near
    copies grows together at a cost linear in the group; once a round links little, all candidates across
    components are compared. What the rounds leave out only makes that last step's work larger.
    """
    edges = short_links(distinct, marked)
    edges = None if edges.isEmpty() else edges
    own = checkpointed(_with_components(distinct, None if edges is None else connected_components(edges)))
    for _ in range(ROUNDS):
        pairs = _nearest_pairs(own)
        near = _verified(pairs, _texts(marked, distinct, _ends(pairs)))
        linked = near.count()
        if linked:
            edges = near if edges is None else edges.union(near)
            own = checkpointed(_with_components(distinct, connected_components(edges)))
        if 4 * linked < pairs.count() or not linked:
            break
    rest = _across(own, distinct, marked)
    return rest if edges is None else edges.union(rest)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near copies.

    Groups are what is linked by verified pairs; texts that agree in their whole set always are. Texts
    without a word (null, empty, white space) are one group. Words are lower-cased (A-Z) runs of
    non-white-space, and whole texts count, however long. That row stands which has the group's
    smallest doc_id; of rows sharing it, and in groups that have null ids only, the one with the least
    hash of its text, then of all its columns. An empty table gives no rows. Columns may have any name.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    each = marked.mapInArrow(_sets, "doc_id long, mark long, sid long, n long, " + ", ".join(f"{w} long" for w in _PRINT))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    distinct = each.groupBy("sid").agg(first, F.first("n").alias("n"), *(F.first(w).alias(w) for w in _PRINT))
    distinct = checkpointed(distinct.repartition(shuffle_partitions(docs.sparkSession), "sid"))
    roots = connected_components(links(distinct.where("n > 0"), marked))
    of = distinct.join(roots, distinct.sid == roots.node, "left").select("first", F.coalesce("root", "sid").alias("root"))
    return standing_rows(docs, of)
