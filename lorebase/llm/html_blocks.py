"""Main text of web pages: a bidirectional LSTM labels every block of a page, reading the page from both ends.

A page becomes its sequence of leaf blocks. Each block is a vector of its tag path (tags, classes, ids and
roles, hashed, weaker the further out), of its words (hashed) and of a dozen plain figures. The
network sees the whole sequence in both directions, however long it is, and gives each block a
probability of being main text. It is trained here: on a bounded sample of the table's pages, labelled
by the markup that tells (weak labels; blocks that no markup tells about don't count), and on pages laid out
anew from the sample's own texts in many ways, with and without telling names, whose labels are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, slices

#: The sample that trains the network: pages, characters of a page, pages laid out anew for each.
SAMPLE, SAMPLE_CHARS, ANEW = 200, 20_000, 8
#: Hashed places for path and words, plain figures, state of each direction.
PATH, WORDS, PLAIN, HIDDEN = 320, 48, 12, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title template noscript svg math textarea select iframe object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr input button".split())
#: A start tag ends an open element of these, if none of the second is open within.
ENDS = {"p": ({"p"}, {"table", "button", "object"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Names by which markup tells what a part is for. Fixed values.
ASIDE_TAGS = frozenset("nav footer aside form header menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager toc".split(),
    "header": "header masthead topbar banner branding logo site-header".split(),
    "footer": "footer copyright legal colophon imprint site-footer bottom".split(),
    "sidebar": "sidebar aside widget rail secondary related recommended trending popular teaser more".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "comments": "comment comments discussion reply replies respond thread reader-comments disqus feedback".split(),
    "share": "share social follow like tweet".split(),
}
MAIN_NAMES = "article content main post entry story body text article-body post-content entry-content main-content".split()
NEUTRAL = "wrap wrapper container row col inner outer box page block grid section layout left right center a1 x2 c3 css-1k item group area region".split()
#: Words that such parts use, in the tables' languages. Fixed values.
SAYS = {
    "menu": "Home News About Contact Start Über Accueil Inicio Archive".split(),
    "header": "Welcome to our site;The daily page;Willkommen;Bienvenue;Log in".split(";"),
    "footer": "© 2024 All rights reserved;Copyright;Privacy policy;Terms of use;Impressum;Mentions légales;Aviso legal".split(";"),
    "sidebar": "Related articles;Most read;You may also like;Mehr zum Thema;À lire aussi;Lo más leído".split(";"),
    "notice": "We use cookies to improve your visit.;This site uses cookies. Accept?;Diese Seite verwendet Cookies.;Ce site utilise des cookies.".split(";"),
    "advert": "Advertisement;Sponsored;Buy now;Anzeige;Publicité;Publicidad".split(";"),
    "form": "Your email;Subscribe to our newsletter;Search;Sign up;Name;Submit".split(";"),
    "comments": "Reply;Leave a comment;3 comments;says;Great post, thanks!;Antworten;Répondre".split(";"),
    "share": "Share;Tweet;Follow us;Teilen;Partager".split(";"),
}


@dataclass
class Block:
    """A leaf of a page: the names along its path (outermost first), its text, and the share of it in links."""

    path: list[list[str]]
    text: str
    links: float


def names_of(tag: str, attrs: list) -> list[str]:
    """The names an element gives: its tag, and the parts of its classes, id and role, lower-cased."""
    found = [f"<{tag}>"]
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for word in re.sub(r"([a-z])([A-Z])", r"\1 \2", value[:300]).lower().split():
                found.append(word)
                found += [x for x in re.split(r"[-_:]+", word) if x and x != word]
    return found


class _Leaves(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = self.unread = self.in_link = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(Block([n for t, n in self.open if t not in INLINE], text, min(1.0, self.linked / len(text))))
        self.text, self.linked = [], 0

    def close_to(self, place: int) -> None:
        gone = self.open[place:]
        if any(t not in INLINE for t, _ in gone):
            self.flush()
        self.in_link -= sum(t == "a" for t, _ in gone)
        self.unread -= sum(t in UNREAD for t, _ in gone)
        del self.open[place:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            ends, within = ENDS[tag]
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in ends:
                    self.close_to(k)
                    break
                if self.open[k][0] in within:
                    break
        elif tag not in INLINE and tag not in UNREAD and tag not in VOID and any(t == "p" for t, _ in self.open[-6:]):
            self.close_to(max(k for k, (t, _) in enumerate(self.open) if t == "p"))  # a paragraph holds no other block
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            self.open.append((tag, names_of(tag, attrs)))
            self.in_link += tag == "a"
            self.unread += tag in UNREAD

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_to(k)
                break

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.text.append(data)
            if self.in_link > 0:
                self.linked += len(data.strip())


def leaves(html: str | None) -> list[Block]:
    """The page's blocks in order: texts between block tags, references decoded, white space turned into one space."""
    parser = _Leaves()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def weak_label(block: Block) -> int:
    """1: within an article, 0: within a part that isn't, -1: the markup doesn't tell. The innermost name counts."""
    for names in reversed(block.path):
        tag = names[0][1:-1]
        if tag in ASIDE_TAGS or _ASIDE.intersection(names[1:]):
            if tag == "header" and any(n[0] in ("<article>", "<main>") for n in block.path):
                continue
            return 0
        if tag in MAIN_TAGS or _MAIN.intersection(names[1:]):
            return 1
    return -1


_ASIDE = frozenset(x for names in ASIDE_NAMES.values() for x in names)
_MAIN = frozenset(MAIN_NAMES)


class Vectors:
    """Blocks as vectors; places of words and vectors of paths are kept as long as they are few."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.paths: dict[tuple, np.ndarray] = {}

    def path(self, path: list[list[str]]) -> np.ndarray:
        """The hashed names of a path, each element weaker than the one within it."""
        v, weight = np.zeros(PATH, np.float32), 1.0
        for depth, names in enumerate(reversed(path[-12:])):
            for name in names if depth else [*names, "leaf " + names[0]]:
                h = crc32(name.encode("utf-8", "replace"))
                v[h % PATH] += weight if h >> 20 & 1 else -weight
            weight *= 0.85
        return v

    def places(self, words: list[str]) -> list[int]:
        """A word's place among WORDS, and WORDS more if it counts as negative."""
        kept = self.words
        if len(kept) > 300_000:
            kept.clear()
        found = [kept.get(w, -1) for w in words]
        if -1 in found:
            for i, at in enumerate(found):
                if at < 0:
                    h = crc32(words[i].encode("utf-8", "replace"))
                    found[i] = kept[words[i]] = h % WORDS + (0 if h >> 20 & 1 else WORDS)
        return found

    def page(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        out = np.zeros((n, PATH + WORDS + PLAIN), np.float32)
        keys, same = [tuple(map(tuple, b.path)) for b in blocks], {}
        if len(self.paths) > 20_000:
            self.paths.clear()
        for i, (b, key) in enumerate(zip(blocks, keys, strict=True)):
            if (v := self.paths.get(key)) is None:
                v = self.paths[key] = self.path(b.path)
            out[i, :PATH] = v
            same[key] = same.get(key, 0) + 1
        texts = [b.text for b in blocks]
        for a in range(0, n, 64):  # so many blocks' words at once
            split = [t.split(" ") for t in texts[a : a + 64]]
            places = np.array(self.places([w for words in split for w in words]), np.int64)
            rows = np.repeat(np.arange(len(split)), [len(words) for words in split])
            counts = np.bincount(rows * (2 * WORDS) + places, minlength=2 * WORDS * len(split)).reshape(-1, 2 * WORDS)
            v = (counts[:, :WORDS] - counts[:, WORDS:]).astype(np.float64)
            out[a : a + 64, PATH : PATH + WORDS] = v / np.maximum(1.0, np.sqrt((v * v).sum(1, keepdims=True)))
            out[a : a + 64, PATH + WORDS + 2] = np.log1p([len(words) for words in split]) / 4
        chars, at = np.array([len(t) for t in texts], np.float64), np.arange(n)
        plain = out[:, PATH + WORDS :]
        plain[:, 0], plain[:, 1], plain[:, 3] = 1, np.log1p(chars) / 5, [b.links for b in blocks]
        plain[:, 4], plain[:, 5] = [t[-1] in ".!?…\"”»%$#*&" for t in texts], np.minimum(1, chars / 200)
        plain[:, 6], plain[:, 7] = [len(_DIGITS.findall(t, 0, 200)) / min(len(t), 200) for t in texts], [t[0].isupper() for t in texts]
        plain[:, 8], plain[:, 9], plain[:, 10] = at / max(n, 1), 1 / (1 + at), 1 / (n - at)
        plain[:, 11] = np.log1p([same[k] for k in keys]) / 4
        return out


_DIGITS = re.compile(r"\d")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs, one from each end, and a logistic output on both states of a block."""

    def __init__(self, seed: int = 7):
        rng, d = np.random.default_rng(seed), PATH + WORDS + PLAIN
        self.p: dict[str, np.ndarray] = {"v": rng.normal(0, 0.2, 2 * HIDDEN), "c": np.zeros(1)}
        for way in "fb":
            self.p |= {f"x{way}": rng.normal(0, d**-0.5, (d, 4 * HIDDEN)), f"h{way}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b{way}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _read(self, x: np.ndarray, real: np.ndarray, way: str, keep: bool):
        """States (time, page, HIDDEN) in one direction, and what the gradient needs if ``keep``."""
        steps, pages = real.shape
        inner = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, kept = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inner[t] + h @ self.p[f"h{way}"]
            gates, g, m = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :]), real[t][:, None]
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep:
                kept.append((t, i, f, o, g, c, th, h, m))
            c, h = np.where(m, c2, c), np.where(m, o * th, h)
            states[t] = h
        return states, kept

    def logits(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        forth, back = self._read(x, real, "f", False)[0], self._read(x, real, "b", False)[0]
        return np.concatenate([forth, back], 2) @ self.p["v"] + self.p["c"]

    def gradient(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean logistic loss of a batch (time, page, ...) and its gradient, back through time."""
        (forth, kept_f), (back, kept_b) = self._read(x, real, "f", True), self._read(x, real, "b", True)
        both = np.concatenate([forth, back], 2)
        out = _sigmoid(both @ self.p["v"] + self.p["c"])
        total = max(weight.sum(), 1e-6)
        loss = -(weight * np.where(y == 1, np.log(out + 1e-7), np.log(1 - out + 1e-7))).sum() / total
        d_out = (weight * (out - y) / total).astype(np.float32)
        grad = {"v": np.einsum("tb,tbh->h", d_out, both), "c": d_out.sum(keepdims=True)[0]}
        d_both = d_out[:, :, None] * self.p["v"]
        for way, kept, d_states in (("f", kept_f, d_both[:, :, :HIDDEN]), ("b", kept_b, d_both[:, :, HIDDEN:])):
            dz_all, dh_w = np.zeros((*real.shape, 4 * HIDDEN), np.float32), np.zeros_like(self.p[f"h{way}"])
            dh, dc = np.zeros_like(forth[0]), np.zeros_like(forth[0])
            for t, i, f, o, g, c, th, h, m in reversed(kept):
                dh = dh + d_states[t]
                dh_in, dc_in = np.where(m, dh, 0), np.where(m, dc, 0)
                d_c2 = dc_in + dh_in * o * (1 - th * th)
                dz = np.concatenate([d_c2 * g * i * (1 - i), d_c2 * c * f * (1 - f), dh_in * th * o * (1 - o), d_c2 * i * (1 - g * g)], 1)
                dz_all[t] = dz
                dh_w += h.T @ dz
                dh, dc = np.where(m, 0, dh) + dz @ self.p[f"h{way}"].T, np.where(m, 0, dc) + d_c2 * f
            grad |= {f"x{way}": np.tensordot(x, dz_all, ((0, 1), (0, 1))), f"h{way}": dh_w, f"b{way}": dz_all.sum((0, 1))}
        return float(loss), grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.01, batch: int = 32) -> float:
        """Adam over batches of pages of like lengths; labels of -1 don't count. The last epoch's mean loss."""
        rng, m, v, step, mean = np.random.default_rng(11), {}, {}, 0, 0.0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        for epoch in range(epochs):
            losses = []
            for b in rng.permutation(len(batches)):
                x, real, y = padded([pages[k] for k in batches[b]])
                loss, grad = self.gradient(x, real, y, ((y >= 0) & real).astype(np.float32))
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * 0.5 ** (epoch / 4) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses)) if losses else 0.0
        return mean

    def main(self, vectors: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """For each page which of its blocks are main text; pages of like lengths side by side."""
        found: list = [np.zeros(0, bool)] * len(vectors)
        order, at = sorted((k for k in range(len(vectors)) if len(vectors[k])), key=lambda k: len(vectors[k])), 0
        while at < len(order):
            take = max(1, min(128, cells // len(vectors[order[at]])))
            group = order[at : at + take]
            while len(group) > 1 and len(group) * len(vectors[group[-1]]) > 2 * cells:
                group = group[: len(group) // 2]
            x, real, _ = padded([(vectors[k], np.zeros(len(vectors[k]))) for k in group])
            out = self.logits(x, real) >= 0
            for j, k in enumerate(group):
                found[k] = out[: len(vectors[k]), j]
            at += len(group)
        return found


def padded(pages: list[tuple[np.ndarray, np.ndarray]]):
    """(time, page, vector), which cells are real, and labels."""
    steps = max(len(y) for _, y in pages)
    x = np.zeros((steps, len(pages), pages[0][0].shape[1]), np.float32)
    real, y = np.zeros((steps, len(pages)), bool), np.full((steps, len(pages)), -1.0, np.float32)
    for k, (vectors, labels) in enumerate(pages):
        x[: len(labels), k], real[: len(labels), k], y[: len(labels), k] = vectors, True, labels
    return x, real, y


def laid_out(rng: np.random.Generator, main: list[str], others: list[str]) -> list[tuple[Block, int]]:
    """A page laid out anew: the texts ``main`` as its article among other parts, with telling names or without."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    semantic, named = rng.random() < 0.5, rng.random() < 0.9
    around = [["<div>", pick(NEUTRAL)] if rng.random() < 0.7 else ["<div>"] for _ in range(int(rng.integers(0, 4)))]

    def words(least: int, most: int) -> str:
        found = pick(others).split(" ")
        n, at = int(rng.integers(least, most + 1)), int(rng.integers(len(found)))
        return " ".join(found[at : at + n]) or found[0]

    def part(role: str, tags: list[str], told: bool, inner: list[tuple[list[str], str, float]], within: list[list[str]] | None = None) -> list[tuple[Block, int]]:
        tag = pick(tags) if semantic or not named else "div"
        name = pick(ASIDE_NAMES[role])
        if rng.random() < 0.3:
            name = f"{name}-{pick(['list', 'box', 'area', 'wrapper', 'top', 'section', 'slot', 'unit'])}"
        own = names_of(tag, [("class", name)]) if told or tag == "div" and named else [f"<{tag}>"]
        return [(Block([*(around if within is None else within), own, *([["<div>", pick(NEUTRAL)]] if rng.random() < 0.3 else []), *([x] if isinstance(x[0], str) else x)], text, links), 0) for x, text, links in inner if text]

    listed = lambda n: [([["<ul>"], ["<li>"]], words(1, 4) if rng.random() < 0.7 else pick(SAYS["menu"]), 1.0) for _ in range(n)]
    lines = lambda role, n, least, most: [(pick([["<p>"], ["<div>"], ["<span>"], ["<h3>"], ["<li>"]]), pick(SAYS[role]) if rng.random() < 0.4 else words(least, most), float(rng.random() < 0.3)) for _ in range(n)]
    some = lambda low, high: int(rng.integers(low, high + 1))
    maybe = lambda share, make: make() if rng.random() < share else []
    advert = lambda within=None: part("advert", ["div", "aside"], True, lines("advert", some(1, 2), 2, 14), within)
    holder = pick([["<article>"], ["<main>"], ["<article>"]]) if semantic else ["<div>"]
    if rng.random() < 0.85 and (named or not semantic):
        holder = [*holder, *names_of("x", [("class", pick(MAIN_NAMES))])[1:]]
    inner = [["<div>", pick(NEUTRAL)]] if rng.random() < 0.3 else []
    body: list[tuple[Block, int]] = []
    leaf: list[list[str]] = []
    for k, text in enumerate(main):
        if rng.random() < 0.25:  # short ones occur in articles too
            cut, at = text.split(" "), some(0, 30)
            text = " ".join(cut[at % len(cut) :][: some(1, 9)])
        head = k == 0 and rng.random() < 0.8
        leaf = [pick([["<h1>"], ["<h2>"]])] if head else [["<h2>"]] if len(text) < 60 and rng.random() < 0.4 else pick([[["<p>"]]] * 5 + [leaf] * 9 * (k > 1 and leaf != [["<h1>"]]) + [[["<blockquote>"], ["<p>"]], *[[["<ul>"], ["<li>"]]] * 3, [["<table>"], ["<tr>"], ["<td>"]], [["<pre>"]], [["<figure>"], ["<figcaption>"]], [["<div>"]], []])
        if head and rng.random() < 0.2:
            leaf = [["<header>"], *leaf]
        body.append((Block([*around, holder, *inner, *leaf], text, float(rng.random() < 0.1) * 0.3), 1))
        if rng.random() < 0.15:
            body += advert([*around, holder, *inner])
    top = maybe(0.3, lambda: part("notice", ["div", "dialog", "aside"], True, lines("notice", some(1, 3), 5, 25)))
    top += maybe(0.6, lambda: part("header", ["header"], named, lines("header", some(1, 2), 1, 6)))
    top += maybe(0.9, lambda: part("menu", ["nav"], named, listed(some(3, 12)))) + maybe(0.5, advert)
    side = lambda: maybe(0.5, lambda: part("sidebar", ["aside"], True, lines("sidebar", some(1, 3), 2, 30) + listed(some(0, 6))))
    if rng.random() < 0.3:  # what follows the article may lie within what holds it
        around = [*around, holder]
    end = maybe(0.3, lambda: part("share", ["div"], True, lines("share", some(1, 4), 1, 3)))
    end += maybe(0.3, lambda: part("form", ["form"], True, lines("form", some(1, 4), 1, 12)))
    end += maybe(0.5, lambda: part("comments", ["section", "div"], True, [([pick([["<div>", "comment"], ["<li>", "comment"], ["<div>"], ["<article>", "comment"]]), *([["<p>"]] if rng.random() < 0.8 else [])], pick(SAYS["comments"]) if rng.random() < 0.3 else words(3, 60), 0.0) for _ in range(some(1, 8))]))
    end += maybe(0.3, lambda: part("notice", ["div", "dialog"], True, lines("notice", some(1, 2), 5, 25)))
    end += maybe(0.85, lambda: part("footer", ["footer"], named, lines("footer", some(1, 3), 2, 16) + listed(some(0, 5))))
    return top + side() + body + side() + end


def train(htmls: list[str], seed: int = 3) -> BiLstm:
    """The network for a sample of pages; without pages, or if no markup tells, it learns from laid-out pages of fixed words alone."""
    rng, vectors, pages, texts, others = np.random.default_rng(seed), Vectors(), [], [], []
    for html in htmls:
        blocks = leaves(html)[:200]
        labels = np.array([weak_label(b) for b in blocks], np.float32)
        if len(blocks):
            pages.append((vectors.page(blocks), labels))
            texts.append([b.text for b, y in zip(blocks, labels, strict=True) if y == 1][:60])
            others += [b.text for b in blocks]
    texts = [t for t in texts if t] or [["A heading", "One sentence of some words follows another one, and so it goes on.", "The end is near."]]
    others = others or [" ".join(x) for x in SAYS.values()]
    for _ in range(ANEW * max(len(htmls), 40)):
        made = laid_out(rng, texts[int(rng.integers(len(texts)))], others)
        pages.append((vectors.page([b for b, _ in made]), np.array([y for _, y in made], np.float32)))
    net = BiLstm()
    net.fit(pages)
    return net


def fitted(pages: DataFrame) -> BiLstm:
    """The network trained on SAMPLE pages of least id hash, SAMPLE_CHARS characters of each."""
    rows = least_hashed(pages.where("html is not null").select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html")), "page_id", SAMPLE, "html")
    return train([r["html"] for r in rows.select("html").collect()])


def _task(it, net: BiLstm) -> Iterator[pa.RecordBatch]:
    vectors = Vectors()
    for batch in slices(it, 256):
        blocks = [leaves(html) for html in batch.column("html").to_pylist()]
        texts = ["\n\n".join(b.text for b, y in zip(own, main, strict=True) if y) for own, main in zip(blocks, net.main([vectors.page(b) for b in blocks]), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, net: BiLstm | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per page: its main blocks in order, two line breaks between them.

    Null and empty pages, and pages of mere markup, give an empty text; null ids and urls stay; repeated rows
    give equal rows; a very long page is one sequence; broken markup is read as browsers read it, more or
    less; columns beside page_id, url and html may have any name; an empty table gives an empty one.
    """
    net = net or fitted(pages)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(lambda it: _task(it, net), "page_id long, url string, text string, n_chars long")
