"""Secret scans: fixed rules, and character Markov models compared by log-likelihood ratio.

The rules give the base spans. Beyond them, a long token is a secret if an order-1 model of random
strings explains it better than one of ordinary identifiers, by more a character than nearly all
ordinary tokens of the sample. Both models are trained here: the random one on the secrets that the rules label in
a bounded sample and on seeded random strings, the ordinary one on the sample's other tokens and on
identifiers made of its words.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, least_hashed, piece, slices

#: The order in which kinds with the same start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Texts of the labelled sample (least hash of doc_id), characters of each (a piece of longer texts), and seeded strings.
SAMPLE_ROWS, PIECE_CHARS, SEEDED = 1_000, 4_000, 4_000
#: A secret's log-likelihood ratio a character is over that of all but a QUANTILE of the ordinary long
#: tokens (so that unlabelled secrets among them don't set it) by MARGIN, and its whole ratio over LEAST.
QUANTILE, MARGIN, LEAST = 0.02, 0.1, 4.0

_CLASS = np.full(256, 64, np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _CLASS[_c] = _i
for _i, _c in enumerate(b"_=-"):
    _CLASS[_c] = 65 + _i
_STATES = 68


def _long_words(text: str, least: int):
    """(start, word) of the white-space separated words of ``least`` characters or more."""
    at = 0
    for word in text.split():
        if len(word) >= least:
            at = text.index(word, at)
            yield at, word
            at += len(word)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The rules' spans (kind, start, end), unsorted: leftmost non-overlapping in each kind, failing ones dropped."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for at, word in _long_words(text, 16):
        out += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(word)]
    return out


def _codes(token: str) -> np.ndarray:
    return _CLASS[np.frombuffer(token.encode("ascii"), np.uint8)]


class Markov:
    """Order-1 log-probabilities of characters, add-half smoothed."""

    def __init__(self, tokens):
        first, pair = np.full(_STATES, 0.5), np.full(_STATES * _STATES, 0.5)
        tokens = [t for t in tokens if t]
        if tokens:
            c, ends = _codes("".join(tokens)), np.cumsum([len(t) for t in tokens])
            inside = np.ones(len(c), bool)
            inside[ends[:-1]] = False
            first += np.bincount(c[np.concatenate([[0], ends[:-1]])], minlength=_STATES)
            pair += np.bincount((c[:-1] * _STATES + c[1:])[inside[1:]], minlength=_STATES * _STATES)
        pair = pair.reshape(_STATES, _STATES)
        self.first, self.pair = np.log(first / first.sum()), np.log(pair / pair.sum(axis=1, keepdims=True))

    def log_probability(self, c: np.ndarray) -> float:
        return float(self.first[c[0]] + self.pair[c[:-1], c[1:]].sum())


class Scanner:
    """The two models and the ratio a character from which on a token is a secret."""

    def __init__(self, secrets: list[str], ordinary: list[str]):
        self.secret, self.ordinary = Markov(secrets), Markov(ordinary)
        seen = [self.ratio(t) / len(t) for t in ordinary if len(t) >= 16]
        self.threshold = max(0.0, float(np.quantile(seen, 1 - QUANTILE)) if seen else 0.0) + MARGIN

    def random(self, token: str) -> bool:
        ratio = self.ratio(token)
        return ratio > LEAST and ratio > self.threshold * len(token)

    def ratio(self, token: str) -> float:
        """Log-likelihood ratio of random string to ordinary identifier."""
        c = _codes(token)
        return self.secret.log_probability(c) - self.ordinary.log_probability(c)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans by start, then kind as listed: the rules' and those of the models that no rule's span meets."""
        out = base_spans(text)
        if text:
            taken = Taken((a, b) for _, a, b in out)
            for at, word in _long_words(text, 16):
                for m in TOKEN.finditer(word):
                    a, b = at + m.start(), at + m.end()
                    if not taken.meets(a, b) and self.random(m[0]):
                        out.append(("random", a, b))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _random_strings() -> list[str]:
    """Seeded: hexadecimal, base64, upper-case and mixed strings of 16 to 64 characters."""
    rng = random.Random(17)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sets = ("0123456789abcdef", upper + lower + digits + "+/", upper + digits, upper + lower + digits + "_-", lower + digits)
    return ["".join(rng.choices(sets[k % len(sets)], k=rng.randrange(16, 65))) for k in range(SEEDED)]


def labelled(texts: list[str | None]) -> tuple[list[str], list[str]]:
    """(secrets, ordinary tokens): what the rules say of a sample, with seeded strings and joined words."""
    secrets, ordinary = [], []
    for text in texts:
        if not text:
            continue
        spans = sorted((a, b) for _, a, b in base_spans(text))
        secrets += [t for a, b in spans for t in TOKEN.findall(text[a:b])]
        at = 0
        for a, b in [*spans, (len(text), len(text))]:
            ordinary += re.findall(r"[A-Za-z0-9+/_=-]{2,}", text[at:a])
            at = max(at, b)
    rng = random.Random(18)
    words = sorted({w.lower() for w in ordinary if w.isalpha()}) or ["name", "value", "index", "count", "result"]
    joined = []
    for k in range(SEEDED):
        some = rng.choices(words, k=rng.randrange(2, 6))
        joined.append(("_".join(some), "-".join(some), "".join(w.capitalize() for w in some), "_".join(some).upper(), "/".join(some), f"{some[0]}_{rng.randrange(10000)}")[k % 6])
    return _random_strings() + secrets, [t for t in ordinary if not TOKEN.fullmatch(t) or not re.search("[0-9]", t)] + joined


def train(docs: DataFrame) -> Scanner:
    """Train on pieces of SAMPLE_ROWS documents; only these, PIECE_CHARS each at most, reach the driver."""
    text = F.col("text").cast("string")
    some = least_hashed(docs.select("doc_id", piece(text, F.col("doc_id"), PIECE_CHARS).alias("text")), "doc_id", SAMPLE_ROWS, "text")
    return Scanner(*labelled([r.text for r in some.collect()]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of ``docs(doc_id, text)``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. Null text is empty.
    Whole texts are scanned, in time linear in their length. An empty table gives no rows (and models of
    seeded strings only); rows sharing a doc_id are scanned each by itself; spans with one start are
    listed by kind; other columns are ignored.
    """
    scanner = train(docs)

    def run(it):
        kinds = (*[pa.int64()] * 3, pa.string(), pa.string())
        for batch in slices(it):
            out = []
            for text in batch.column(1).to_pylist():
                spans = scanner.spans(text)
                base = [s for s in spans if s[0] != "random"]
                out.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with every secret in ``text`` replaced by ``mark`` (and ``n_chars``, if there, renewed).

    Overlapping spans give one mark. Null texts stay null; every row is kept, and repeated rows are
    masked each by itself.
    """
    scanner, names = train(docs), docs.columns

    def run(it):
        at = names.index("text")
        for batch in slices(it):
            out = []
            for text in batch.column(at).to_pylist():
                parts, end = [], 0
                for _, a, b in scanner.spans(text):
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]) if parts else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
