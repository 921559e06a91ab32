"""PII: fixed rules, and weak supervision for what they nearly match or miss.

Candidates are the rules' spans, near misses of the rules (long digit runs, numbers in groups, numbers
broken over lines, addresses in disguise, account codes) and names after a title. Labelers of three sorts
vote on each: shapes and check digits (regex), gazetteers and context words. Expectation-maximisation
estimates each labeler's reliability and each candidate's probability on a bounded sample; a logistic
span classifier is then trained on these and decides for every candidate of every text that meets no
rule's span.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, least_hashed, piece, slices

#: The order in which kinds are listed; ``weak`` is the classifier's.
KINDS = ("email", "ip", "card", "phone", "weak")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Documents of the sample, characters of each (a piece of longer texts), and candidates of them that EM and the classifier are fitted on.
SAMPLE_ROWS, PIECE_CHARS, SAMPLE_SPANS = 4_000, 4_000, 20_000
#: A span that no labeler speaks for isn't likelier personal than not, however many of the sample are.
MOST_PRIOR = 0.5
#: Cue words, and gazetteers of domain endings, titles, country codes and calling codes.
CUES = ("phone", "tel", "call", "mobile", "cell", "fax", "mail", "contact", "ssn", "social", "passport", "iban", "account", "birth", "born", "name", "address")
ANTICUES = ("version", "page", "chapter", "section", "copyright", "license", "isbn", "table", "figure", "total", "price", "year")
ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk"))
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "madame", "monsieur", "señor", "señora")
COUNTRIES = frozenset(("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PL", "PT", "IE", "SE", "DK", "FI", "NO"))
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "421", "972")
TITLES = "|".join(h.capitalize() for h in HONORIFICS)
CANDIDATE = re.compile(
    r"(?P<abroad>\+[0-9]{1,3}(?:[\s().-]{0,3}[0-9]){6,14}(?![0-9]))"
    r"|(?P<number>(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,6}){1,4}(?![0-9A-Za-z]))"
    r"|(?P<digits>(?<![0-9A-Za-z+])[0-9]{9,19}(?![0-9A-Za-z]))"
    r"|(?P<masked>(?<![A-Za-z0-9])[A-Za-z0-9_-]{2,30}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,30}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z]{2,10})+)"
    r"|(?P<code>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    rf"|(?P<name>(?<![^\W\d_])(?:{TITLES})\.?\x20[^\W\d_a-zà-ÿ][^\W\d_]{{1,20}}(?:\x20[^\W\d_a-zà-ÿ][^\W\d_]{{1,20}})?)"
)
#: What a text with a candidate beside the rules' spans holds.
HINT = re.compile(rf"[0-9]|[\[(]at[\])]|{TITLES}")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The rules' spans (kind, start, end) by kind, then start; each rule takes time in proportion to the text."""
    if not text:
        return []
    out, end = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            floor = max(end, text.rfind("@", end, m.start()) + 1)
            start = floor + len(text[floor : m.start()].rstrip(LOCAL))
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str | None, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(shape, start, end) of spans that look like personal data and meet no span of ``taken``."""
    if not text or not HINT.search(text):
        return []
    spans = Taken((a, b) for _, a, b in taken)
    return [(m.lastgroup, *m.span()) for m in CANDIDATE.finditer(text) if not spans.meets(*m.span())]


def _mod97(code: str) -> bool:
    """Check digits of an account code."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def votes(text: str, shape: str, a: int, b: int) -> list[int]:
    """Each labeler's vote: 1 personal, -1 not, 0 abstains. ``shape`` is a candidate's, or a rule's kind."""
    span, before, after = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 20].lower()
    digits = re.sub(r"[^0-9]", "", span)
    near = re.findall(r"[^\W\d_]+", before)
    groups = re.findall(r"[0-9]+", span)
    card = shape in ("digits", "card") and 13 <= len(digits) <= 19
    plus = span.startswith("+")
    return [
        # regex: the rules, shapes of national numbers, dates and versions, check digits, lengths
        1 if shape in KINDS else 0,
        1 if re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", span) else 0,
        1 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span) else 0,
        -1 if re.fullmatch(r"(?:[0-9]{1,4}[./-]){1,3}[0-9]{1,4}", span) and len(digits) <= 8 else 0,
        1 if shape in ("masked", "name") else 0,
        (1 if _luhn(digits) else -1) if card else 0,
        (1 if _mod97(span) else -1) if shape == "code" else 0,
        (1 if 8 <= len(digits) <= 15 else -1) if plus else 0,
        (1 if 9 <= len(digits) <= 12 else -1) if shape == "number" else 0,
        -1 if digits and len(set(digits)) <= 1 or shape == "number" and len(groups) > 4 else 0,
        # gazetteer: domain endings, country and calling codes, titles
        (1 if re.split(r"[^A-Za-z]+", span.strip())[-1].lower() in ENDINGS else -1) if shape in ("masked", "email") else 0,
        (1 if span[:2] in COUNTRIES else -1) if shape == "code" else 0,
        (1 if digits.startswith(CALLING) else -1) if plus else 0,
        1 if shape == "name" or any(w in HONORIFICS for w in near[-3:]) else 0,
        # context: words before and after
        1 if any(w.startswith(CUES) for w in near[-5:]) else 0,
        -1 if any(w.startswith(ANTICUES) for w in near[-5:]) else 0,
        -1 if re.match(r"\s*(%|€|\$|kg|km|cm|mm|mb|gb)", after) else 0,
    ]


def reliabilities(v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """EM over votes (candidates x labelers): each labeler's accuracy where it votes, each candidate's probability."""
    accuracy, prior = np.full(v.shape[1], 0.7), 0.3
    p = np.full(len(v), prior)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        p = 1 / (1 + np.exp(-(v @ odds + math.log(prior / (1 - prior)))))
        right = ((v == 1) * p[:, None] + (v == -1) * (1 - p[:, None])).sum(axis=0)
        accuracy = np.clip((right + 7.0) / ((v != 0).sum(axis=0) + 10.0), 0.55, 0.98)
        prior = float(np.clip((p.sum() + 3.0) / (len(p) + 10.0), 0.05, MOST_PRIOR))
    return accuracy, p


#: Shapes as the classifier sees them; a rule's spans count as the shape that nearly matches it.
SHAPES = ("abroad", "number", "digits", "masked", "code", "name", "ip")
ALIKE = {"phone": "abroad", "card": "digits", "email": "masked"}


def span_features(text: str, shape: str, a: int, b: int) -> list[float]:
    """What the classifier sees: the votes but that of the rules, which it is to do without, and the span's make-up."""
    span, v, own = text[a:b], votes(text, shape, a, b)[1:], ALIKE.get(shape, shape)
    digits = sum("0" <= c <= "9" for c in span)
    return [1.0, *(float(x == 1) for x in v), *(float(x == -1) for x in v), *(float(own == s) for s in SHAPES), len(span) / 100, digits / 50]


class Classifier:
    """Logistic regression on span features, fitted to EM's probabilities.

    The ridge pulls towards the weights that EM's reliabilities give each vote, so a labeler that no
    span of the sample met counts as EM starts it.
    """

    def __init__(self, x: np.ndarray | None = None, p: np.ndarray | None = None, accuracy: np.ndarray | None = None):
        self.weights = None
        if x is not None and len(x):
            odds = np.log(accuracy / (1 - accuracy))[1:]
            start = np.concatenate([[math.log(0.3 / 0.7)], odds, -odds, np.zeros(x.shape[1] - 1 - 2 * len(odds))])
            w = start.copy()
            for _ in range(25):  # Newton steps
                q = 1 / (1 + np.exp(-x @ w))
                h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(x.shape[1])
                w -= np.linalg.solve(h, x.T @ (q - p) + w - start)
            self.weights = w

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans by kind as listed, then start."""
        out = base_spans(text)
        if self.weights is not None:
            for shape, a, b in candidates(text, out):
                if float(np.dot(self.weights, span_features(text, shape, a, b))) > 0:
                    out.append(("weak", a, b))
        return out


def train(docs: DataFrame) -> Classifier:
    """Fit on the rules' spans and candidates in pieces of SAMPLE_ROWS documents; only votes and features reach the driver."""
    text = F.col("text").cast("string")
    some = least_hashed(docs.select("doc_id", piece(text, F.col("doc_id"), PIECE_CHARS).alias("text")), "doc_id", SAMPLE_ROWS, "text")

    def seen(it):
        for batch in it:
            out = []
            for text in batch.column(0).to_pylist():
                ruled = base_spans(text)
                for shape, a, b in [*ruled, *candidates(text, ruled)]:
                    out.append((votes(text, shape, a, b), span_features(text, shape, a, b)))
            v, x = list(zip(*out, strict=True)) or ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int64())), pa.array(x, pa.list_(pa.float64()))], names=["v", "x"])

    spans = some.select("text").mapInArrow(seen, "v array<long>, x array<double>")
    got = sorted((tuple(r.v), tuple(r.x)) for r in spans.orderBy(F.xxhash64("v", "x"), "v", "x").limit(SAMPLE_SPANS).collect())
    if not got:
        return Classifier()
    accuracy, p = reliabilities(np.array([v for v, _ in got]))
    return Classifier(np.array([x for _, x in got]), p, accuracy)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row of ``docs(doc_id, text)``.

    Spans are kind:start:end in code points, end exclusive, by kind, then start. Null text is empty.
    Without a span in the sample the classifier adds nothing. Whole texts are searched, in time linear
    in their length. An empty table gives no rows; rows sharing a doc_id are searched each by itself;
    spans never share kind and start; other columns are ignored.
    """
    model = train(docs)
    tell = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(it):
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
        for batch in slices(it):
            out = []
            for text in batch.column(1).to_pylist():
                spans = model.spans(text)
                base = [s for s in spans if s[0] != "weak"]
                out.append((*(sum(s[0] == k for s in base) for k in KINDS[:4]), hashlib.sha256(tell(base).encode()).hexdigest(), tell(spans)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
