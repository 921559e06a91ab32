"""Page text: the parser on literal pages, the network's gradient against differences, and results against the articles of the tables."""

import os
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import html_blocks as hb

SF = os.environ.get("LOREBASE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def net(spark):
    return hb.fitted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def article(html):
    """The tables' pages hold one article each: its texts between block tags."""
    body = re.search("<article>(.*)</article>", html or "", re.S)
    parts = re.split("</?(?:h1|p)>", body[1]) if body else []
    return "\n\n".join(t for x in parts if (t := " ".join(unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split())))


def test_all_pages_give_their_articles(spark, net):
    for sf in (SF, "/root/testdata/sf0.01"):
        pages = spark.read.parquet(f"{sf}/pages.parquet")
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in hb.main_text(pages, net).collect()}
        want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
        assert got == {k: (t, len(t)) for k, t in want.items()}


def texts(html):
    return [b.text for b in hb.leaves(html)]


def test_leaves():
    assert texts("<p>a<b>b\n c</b>&amp;&nbsp;d<br>e<p>f</div>g<!-- x --><script>var t='<p>no</p>'</script>") == ["ab c& d e", "f g".split()[0] + "g"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul><style>p{}</style><title>t</title>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p>x<div>y</div>") == ["x", "y"] and texts(None) == texts("") == texts("<div></div> \n") == []
    assert texts("<p>5 < 6 &lt; 7 &#x41; &bogus; <") == ["5 < 6 < 7 A &bogus; <"]
    links = [b.links for b in hb.leaves("<p><a href=x>all</a><p>some <a>link</a><p>none")]
    assert links[0] == 1 and 0 < links[1] < 1 and links[2] == 0
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert texts(deep) == ["core"]


def test_weak_labels():
    page = "<nav><p>m</nav><article><header><h1>t</h1></header><p>a<div class='comment-list'><p>c</div><aside>s</aside></article><div class='x'>?</div>"
    assert {b.text: hb.weak_label(b) for b in hb.leaves(page)} == {"m": 0, "t": 1, "a": 1, "c": 0, "s": 0, "?": -1}


def test_gradient_against_differences():
    rng, net = np.random.default_rng(1), hb.BiLstm()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    d = hb.PATH + hb.WORDS + hb.PLAIN
    x, real, _ = hb.padded([(rng.normal(0, 0.3, (n, d)), np.zeros(n)) for n in (3, 5)])
    x, y = x.astype(np.float64), rng.integers(0, 2, real.shape).astype(float)
    weight = real.astype(float)
    _, grad = net.gradient(x, real, y, weight)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            kept, step = flat[k], 1e-3
            flat[k] = kept + step
            up = net.gradient(x, real, y, weight)[0]
            flat[k] = kept - step
            down = net.gradient(x, real, y, weight)[0]
            flat[k] = kept
            assert abs((up - down) / (2 * step) - np.asarray(grad[name]).reshape(-1)[k]) < 2e-4


def test_batches_change_nothing(net):
    """A page's labels don't depend on the pages beside it."""
    rng = np.random.default_rng(2)
    made = [[b for b, _ in hb.laid_out(rng, ["Title of it"] + ["Some words that go on for a while."] * n, ["other words here", "and there"])] for n in (1, 2, 9, 30, 200)]
    vectors = [hb.Vectors().page(b) for b in made]
    together = net.main([*vectors, np.zeros((0, vectors[0].shape[1]), np.float32)])
    assert all((t == net.main([v])[0]).all() for t, v in zip(together, vectors, strict=False)) and len(together[-1]) == 0


def test_held_out_layouts(spark, net):
    """Pages laid out anew from other texts than the sample's."""
    rng, hit, found, true = np.random.default_rng(50), 0, 0, 0
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy(F.desc("page_id")).limit(60).collect()]
    own = [[b.text for b in hb.leaves(p) if hb.weak_label(b) == 1] for p in pages]
    other = [b.text for p in pages for b in hb.leaves(p)]
    for k in range(300):
        made = hb.laid_out(rng, own[k % 60], other)
        y, got = np.array([v for _, v in made]) == 1, net.main([hb.Vectors().page([b for b, _ in made])])[0]
        hit, found, true = hit + (y & got).sum(), found + got.sum(), true + y.sum()
    assert hit / found > 0.98 and hit / true > 0.98


OTHERS = [
    """<html><body class="home"><header class="site-header"><a href="/">0The Daily</a></header><div id="cookie-notice"><p>0We use cookies and so on,
    please accept all of them now.</p></div><nav><a>0Home</a> <a>News</a></nav><div class="wrap"><div class="post-content"><h1>1My trip</h1><p>1It was a long &amp;
    winding road that led us there.</p><div class="ad-slot">0Buy shoes at low prices today</div><p>1In the end we were   happy to be home.</p></div><aside class="sidebar">
    <h3>0Most read</h3><p>0Some teaser of another story that goes on.</p></aside></div><section id="comments"><div class="comment"><p>0I loved to read this long story
    about your trip.</p></div></section><form action="x"><label>0Your email</label><input></form><footer>0Copyright 2024</footer></body></html>""",
    """<body><div class="topbar"><ul><li><a>0Start</a><li><a>0Sport</a></ul></div><main><article class="story"><h1>1Rain in the north</h1><p>1Heavy rain has fallen since Monday
    evening, and more is on its way.</p><p>1People are asked to stay at home until the roads are open again.</p><ul><li>1Bridges are closed.</li><li>1Trains run late.</li></ul></article>
    <section class="comments-area"><p>0I live there and it is quite bad, be careful.</p><p>0Reply</p></section></main><div class="newsletter"><p>0Subscribe to our newsletter</p></div>
    <footer><p>0All rights reserved</p><ul><li><a>0Privacy policy</a></ul></footer></body>""",
    """<body><div id="content"><h2>1How to bake bread</h2><div>1Mix flour, water, salt and a little yeast in a large bowl.</div><div>1Let it rest for a night, then bake it for
    forty minutes.</div></div><div id="related"><a>0More recipes</a></div><div class="share-bar"><a>0Share</a><a>Tweet</a></div><div class="site-footer">0© 2024 The baker</div></body>""",
]


def test_pages_of_other_kinds(net):
    """Hand-written pages of layouts that the tables don't have; each block's text begins with its label."""
    right = every = 0
    for page in OTHERS:
        blocks = hb.leaves(page)
        want = [b.text[0] == "1" for b in blocks]
        for b in blocks:
            b.text = re.sub("^[01]", "", b.text)
        got = net.main([hb.Vectors().page(blocks)])[0].tolist()
        right, every = right + sum(a == b for a, b in zip(got, want, strict=True)), every + len(want)
    assert right / every >= 0.9


def test_edges(spark, net):
    long = "<article>" + "<p>Word and word again, so it goes.</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<article><h1>T</h1><p>One sentence is here.</p></article>")] * 2 + [(4, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = hb.main_text(df, net).collect()
    assert len(got) == 9 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == by[None]["text"] == "" and by[2]["url"] is None and by[1]["n_chars"] == 0
    assert by[4]["n_chars"] == 30_000 * 32 + 29_999 * 2
    empty = spark.createDataFrame([], df.schema)
    assert hb.main_text(empty).collect() == []
