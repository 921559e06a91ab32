"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton runs over the UTF-8 bytes of a unit; at each byte the matched pieces, found by following
output links, relax the best score there. Many units are run side by side: each step of automaton and
relaxation is one array operation over all of them. A unit is a run of spaces with the word after it,
cut further at control characters that no piece has; no piece of the vocabulary crosses such a cut
(checked when it is loaded), so the units' segmentations joined are the whole text's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Where the public vocabulary files are; a parameter of ``load``.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Distinct units remembered by a task, and bytes of units run side by side.
REMEMBERED, CELLS = 200_000, 1_000_000
#: Below any piece, so that a character falls back to bytes just where nothing covers it.
PENALTY = 10.0


class Vocabulary:
    """Pieces with scores, and the ids that stand for single bytes."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], unknown: int):
        self.pieces, self.scores, self.unknown = pieces, scores, unknown
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        self.normal = [i for i in range(len(pieces)) if i not in special and i not in self.bytes.values() and pieces[i]]
        text = [pieces[i] for i in self.normal]
        if any(SPACE in p.lstrip(SPACE) for p in text):
            raise ValueError("a piece crosses words; units can't be run apart")
        self.cuts = "".join(c for c in "\n\r\t" if not any(c in p for p in text))


def load(path: str = MODEL) -> Vocabulary:
    """Read on the driver; the vocabulary itself travels to the executors."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return Vocabulary([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], special, sp.unk_id())


class Encoder:
    """The automaton in arrays: a dense transition table, output links, and each state's own piece."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        children: list[dict[int, int]] = [{}]
        own, depth = [-1], [0]
        for i in v.normal:
            at = 0
            for b in v.pieces[i].encode():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = children[at][b]
            own[at] = i
        used = sorted({b for c in children for b in c})
        self.kind = np.zeros(256, np.int64)  # class 0: bytes that no piece has
        self.kind[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        n = len(children)
        self.next = np.zeros((n, self.width), np.int32)
        self.piece = np.array(own, np.int64)
        self.link = np.zeros(n, np.int64)
        fail = np.zeros(n, np.int64)
        depth = np.array(depth)
        for level in range(int(depth.max()) + 1):
            states = np.flatnonzero(depth == level)
            if level:
                self.next[states] = self.next[fail[states]]
                self.link[states] = np.where(self.piece[fail[states]] >= 0, fail[states], self.link[fail[states]])
            edges = [(s, self.kind[b], t) for s in states.tolist() for b, t in children[s].items()]
            if edges:
                s, b, t = np.array(edges).T
                if level:
                    fail[t] = self.next[s, b]
                self.next[s, b] = t
        self.next = self.next.reshape(-1)
        self.size = np.where(self.piece >= 0, depth, 0)
        self.score = np.where(self.piece >= 0, np.array(v.scores)[self.piece], 0.0)
        self.fallback = min((v.scores[i] for i in v.normal), default=0.0) - PENALTY
        cuts = re.escape(v.cuts)
        self.unit = re.compile(f" +[^ {cuts}]*|[^ {cuts}]+" + (f"|[{cuts}]" if cuts else ""))

    def units(self, text: str) -> list[str]:
        """The units of a text with the leading space that encoding adds."""
        return self.unit.findall(" " + text.replace(SPACE, " "))

    def segment(self, units: list[str]) -> list[np.ndarray]:
        """The ids of each unit, best total score first; of equal scores the longer last piece."""
        raw = [u.replace(" ", SPACE).encode() for u in units]
        order = sorted(range(len(raw)), key=lambda k: -len(raw[k]))
        out: list = [None] * len(raw)
        at = 0
        while at < len(order):
            some = order[at : at + max(1, CELLS // max(1, len(raw[order[at]])))]
            for k, ids in zip(some, self._viterbi([raw[k] for k in some]), strict=True):
                out[k] = ids
            at += len(some)
        return out

    def _viterbi(self, raw: list[bytes]) -> list[np.ndarray]:
        """``raw`` is ordered from long to short."""
        n, lengths = len(raw), np.array([len(r) for r in raw])
        most = int(lengths[0])
        data = np.zeros((most, n), np.uint8)
        for k, r in enumerate(raw) if n < 64 else ():
            data[: len(r), k] = np.frombuffer(r, np.uint8)
        if n >= 64:
            data = np.frombuffer(b"".join(r.ljust(most, b"\0") for r in raw), np.uint8).reshape(n, most).T.copy()
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((most + 1, n), np.int32)
        chosen = np.full((most + 1, n), -1, np.int32)
        state, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.searchsorted(-lengths, -np.arange(most), side="left")  # units longer than j
        for j in range(most):
            m = int(live[j])
            byte = data[j, :m]
            lead = (byte & 0xC0) != 0x80
            start[:m][lead] = j
            state[:m] = self.next[state[:m] * self.width + self.kind[byte]]
            rows = np.arange(m)
            at = state[:m]
            at = np.where(self.piece[at] >= 0, at, self.link[at])
            goal, size, ids = best[j + 1], back[j + 1], chosen[j + 1]
            while True:
                on = at > 0
                if not on.all():
                    rows, at = rows[on], at[on]
                if not len(rows):
                    break
                step = self.size[at]
                score = best[j + 1 - step, rows] + self.score[at]
                better = score > goal[rows]
                r = rows[better]
                goal[r], size[r], ids[r] = score[better], step[better], self.piece[at[better]]
                at = self.link[at]
            following = data[j + 1, :m] if j + 1 < most else np.zeros(m, np.uint8)
            ends = (lengths[:m] == j + 1) | ((following & 0xC0) != 0x80)
            r = np.flatnonzero(ends)
            score = best[start[r], r] + self.fallback
            better = score > goal[r]
            r = r[better]
            goal[r], size[r], ids[r] = score[better], j + 1 - start[r], -1
        rows, pos, steps = np.arange(n), lengths.copy(), []
        while len(rows):
            took, ids = back[pos, rows], chosen[pos, rows]
            steps.append((rows, ids, pos - took, took))
            pos = pos - took
            rows, pos = rows[pos > 0], pos[pos > 0]
        which = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps]).astype(np.int64)
        began = np.concatenate([s[2] for s in steps])
        took = np.concatenate([s[3] for s in steps])
        order = np.lexsort((began, which))
        which, ids, began, took = which[order], ids[order], began[order], took[order]
        edges = np.searchsorted(which, np.arange(n + 1))
        bare = np.zeros(n, bool)
        bare[which[ids < 0]] = True
        out = []
        for k in range(n):
            own = ids[edges[k] : edges[k + 1]]
            if bare[k]:
                full: list[int] = []
                for i, a, t in zip(own.tolist(), began[edges[k] :].tolist(), took[edges[k] :].tolist(), strict=False):
                    full += [i] if i >= 0 else [self.vocabulary.bytes.get(b, self.vocabulary.unknown) for b in raw[k][a : a + t]]
                own = np.array(full)
            out.append(own.astype(np.int32))
        return out


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.raw = [p.encode() for p in vocabulary.pieces]
        for b, i in vocabulary.bytes.items():
            self.raw[i] = bytes([b])
        for i in set(range(len(self.raw))) - set(vocabulary.normal) - set(vocabulary.bytes.values()):
            self.raw[i] = b""

    def decode(self, ids) -> str:
        """The text of ``ids``: pieces joined, without the space that encoding put first."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Tokenizer:
    """Encoder and decoder with a bounded memory of units; built once in each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoder, self.decoder = Encoder(vocabulary), Decoder(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.edges = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, units = self.known, [self.encoder.units(t) if t else [] for t in texts]
        before = len(known)
        keys = [np.array([known.setdefault(u, len(known)) for u in some], np.int64) for some in units]
        if len(known) > before:
            new = self.encoder.segment(list(known)[before:])
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            self.flat = np.concatenate([self.flat, *new])
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
        out = []
        for k in keys:
            sizes = self.edges[k + 1] - self.edges[k]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(self.edges[k] - ends + sizes, sizes)])
        return out


#: Characters of text encoded at once.
BLOCK = 1_000_000


def tokenize(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip), one row for each row of ``docs(doc_id, text)``.

    ``ids`` is the best segmentation of the whole text; ``round_trip`` tells that decoding gives the
    text back (the piece mark U+2581 itself counts as a space). Null and empty texts have no ids. Whole
    texts are encoded, however long; of segmentations with one score the automaton's first counts. An
    empty table gives no rows; rows sharing a doc_id are encoded each; other columns are ignored.
    """
    vocabulary = load(model)

    def run(it):
        ready = Tokenizer(vocabulary)  # for this task alone, so that an idle worker holds no memory
        for batch in slices(it):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size == 0 or size + len(texts[to]) <= BLOCK):
                    size += len(texts[to]) or 1
                    to += 1
                some = texts[at:to]
                ids = ready.encode(some)
                same = [ready.decoder.decode(i.tolist()) == t.replace(SPACE, " ") for i, t in zip(ids, some, strict=True)]
                edges = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(edges).astype(np.int64)), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
