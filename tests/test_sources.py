import io
import random
import zipfile

import pytest

from pyspark.sql import functions as F
from lorebase.operators import chunking as C
from lorebase.operators import library as L
from lorebase.sources import documents as D
from lorebase.sources import stores as S


def test_markdown():
    rows = D.parse_markdown("pre\n# One\nbody\n## Part *a*\nx\n```\n# not one\n```\n# Chapter 7 Two #\nend")
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [("Ch01", "One", 1, None), ("Ch01/§Part-a", "Part *a*", 2, "Ch01"), ("Ch07", "Chapter 7 Two", 1, None)]
    assert rows[1][6].endswith("```") and rows[0][6] == "# One\nbody"
    assert [r[2:4] for r in D.parse_markdown("Title\n=====\nx\n\nSub\n---\ny")] == [("Title", 1), ("Sub", 2)]
    assert [r[1] for r in D.parse_markdown("## a\n## a\n### b\n### b")] == ["Ch01", "Ch02", "Ch02/§b", "Ch02/§b-2"]
    assert D.parse_markdown("no heading") == [] and D.parse_markdown("") == []


def test_html(spark):
    rows = D.parse_html("<body><h1>A <b>x</b></h1>one<script>h()</script><p>two &amp; three</p><h3>A x</h3>four<style>s</style></body>")
    assert [(r[1], r[2], r[6]) for r in rows] == [("Ch01", "A x", "one\ntwo & three"), ("Ch01/§A-x", "A x", "four")]
    assert D.sanitise('<p onclick="x()">a<script>b</script><a href="javascript:1" title="t">c</a><br><x>d</x>&lt;</p><!-- e -->') == '<p>a<a title="t">c</a><br>d&lt;</p>'
    df = spark.createDataFrame([(1, "<h2>t</h2>b"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.path, r.body) for r in D.html_sections(df).collect()] == [(1, "Ch01", "b")]


def test_a_label_cut_off_within_a_reference_keeps_the_rest_of_it():
    rows = D.parse_html("<h1>A&amp;&amp</h1>x<h2>B &lt;b&gt; &#39;c&#x27; &amp;lt; &l</h2><h2>R&D & more;</h2>")
    assert [r[2] for r in rows] == ["A&&amp", "B <b> 'c' &lt; &l", "R&D & more;"]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="Kopf1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark):
    rows = D.parse_docx(docx([("", "intro"), ("Kopf1", "First"), ("", "a"), ("Heading2", "Part"), ("", "b")]))
    assert [(r[1], r[6]) for r in rows] == [("Ch01-Preamble", "intro"), ("Ch01", "First\n\na"), ("Ch01/§Part", "Part\n\nb")]
    assert [r[1] for r in D.parse_docx(docx([("", "x"), ("", "y")]))] == ["Ch01"] and D.parse_docx(docx([])) == []
    df = spark.createDataFrame([(1, bytearray(docx([("Heading1", "H")])))], "doc_id long, content binary")
    assert [r.label for r in D.docx_sections(df).collect()] == ["H"]


def test_outlines_and_pages(spark):
    pages = spark.createDataFrame([(1, ["p0", "p1", "p2", "p3"])], "doc_id long, page_texts array<string>")
    nodes = [(1, 0, 0, "Intro", 0), (1, 1, 1, "Sec a", 1), (1, 2, 2, "deep", 1), (1, 3, 0, "Chapter 9", None), (1, 4, 0, "End", 3)]
    outline = spark.createDataFrame(nodes, "doc_id long, pos int, depth int, title string, page_index int")
    got = [(r.path, r.body) for r in D.outline_sections(outline, pages).orderBy("pos").collect()]
    assert got == [("Ch01", "p0"), ("Ch01/§Sec-a", "p1\n\np2\n\np3"), ("Ch02", ""), ("Ch03", "p3")]
    texts = spark.createDataFrame([(1, ["Chapter 1\na", "b", "Chapter 2 long name\nc", "\nChapter 2\nd"]), (2, ["x", "y"]), (3, ["", " "])], "doc_id long, page_texts array<string>")
    got = sorted((r.doc_id, r.path, r.label) for r in D.page_chapters(texts).collect())
    assert got == [(1, "Ch01", "Chapter 1"), (1, "Ch02", "Chapter 2 long name"), (2, "Ch01", "Ch01")]


def test_front_matter_and_events(spark):
    df = spark.createDataFrame([('---\ntitle: "T x" # c\n# note\nlang: de\n---\nbody\n',), ("plain",)], "t string")
    m, body = D.front_matter(df.t)
    assert [tuple(r) for r in df.select(m, body).collect()] == [({"title": "T x", "lang": "de"}, "body\n"), ({}, "plain")]
    df = spark.createDataFrame([("event: a\r\ndata: 1\r\ndata: 2\r\n\r\n: note\n\nevent: b\n\ndata:3\n\n",)], "t string")
    assert [tuple(e) for e in df.select(D.sse_events(df.t).alias("e")).first().e] == [("a", "1\n2"), ("", "3")]


def test_files(spark, tmp_path):
    (tmp_path / "a.MD").write_text("# x")
    (tmp_path / "b.bin").write_text("no")
    got = D.register_files(spark, str(tmp_path)).collect()
    assert [(r.file_format, r.file_size) for r in got] == [("md", 3)]


def test_windows_cover_and_overlap():
    text = "\n\n".join(" ".join(f"word{i} is here." for i in range(k, k + 60)) for k in range(0, 3000, 60))
    pieces = C.window_pieces(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and len(pieces) > 5
    assert all(b2 > b1 and a2 <= b1 for (_, b1), (a2, b2) in zip(pieces, pieces[1:], strict=False))
    assert all(C.LEAST <= b - a <= C.MOST for a, b in pieces[:-1])
    fenced = "a " * 1300 + "\n```\n" + "code. " * 400 + "\n```\n" + "b " * 2000
    assert all(len(C.FENCE.findall(fenced[a:b])) % 2 == 0 for a, b in C.window_pieces(fenced)[:1])
    inline = "a ``` b. " * 1000  # not at a line's beginning, so no fence
    assert all(b - a <= C.MOST for a, b in C.window_pieces(inline))
    endless = "x\n~~~\n" + "code " * 4000
    assert C.window_pieces(endless)[0] == (0, C.FENCED_MOST)
    loose = "One sentence here. " * 150 + "and then words " * 200
    assert loose[: C.window_pieces(loose)[0][1]].rstrip().endswith("here.")
    assert C.window_pieces("") == [] and C.window_pieces("x") == [(0, 1)]


def plain_windows(text):
    """The contract of windows without code fences, step by step."""
    out, start = [], 0
    while start < len(text):
        end = len(text)
        if end - start > 4000:
            lo, hi = start + 2400, start + 4000
            ends = {}
            for at in range(lo, hi):
                if text[at : at + 2] == "\n\n" and at + 2 <= hi:
                    ends[0] = at + 2
                if text[at] == "\n":
                    ends[1] = at + 1
                if text[at] in ".!?" and at + 1 < hi and text[at + 1].isspace():
                    to = at + 1
                    while to < hi and text[to].isspace():
                        to += 1
                    ends[2] = to
                if text[at] == " ":
                    ends[3] = at + 1
            end = ends[min(ends)] if ends else hi
            if text[start:end].rstrip()[-1:] not in tuple(".!?"):
                inner = [at + 1 for at in range(start, end - 1) if text[at] in ".!?" and text[at + 1].isspace()]
                if inner and inner[-1] - start >= 100:
                    end = inner[-1]
        out.append((start, end))
        if end == len(text):
            break
        start = max(start + 1, end - 480)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_against_the_contract(seed):
    rng = random.Random(seed)
    ends = [[" "], [" ", ". "], [" "] * 30 + [". ", "! "], [" "] * 40 + [".\n", "\n"], [" "] * 60 + [".\n\n", "\n\n"], [""]][seed]
    text = "".join("w" * rng.randrange(1, 9) + rng.choice(ends) for _ in range(6000))
    assert C.window_pieces(text) == plain_windows(text)


def test_chunk_sequences(spark):
    pages = spark.createDataFrame([(1, ["first page. " * 400, "", None, "second. " * 10]), (2, ["", " "])], "doc_id long, page_texts array<string>")
    got = C.page_chunks(pages).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.ord, r.section_path, r.page, r.prev_ord, r.next_ord, r.parent_ord) for r in got] == [(1, 0, "p.1", 1, None, 1, None), (1, 1, "p.1", 1, 0, None, 0), (1, 2, "p.4", 4, None, None, None)]
    sections = D.markdown_sections(spark.createDataFrame([(7, "# A\n\n" + "text one. " * 500 + "\n\n# B\n\nshort.")], "doc_id long, text string"))
    got = C.section_chunks(sections).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(len(got))) and len(got) >= 3 and got[-1].parent_ord is None and got[1].parent_ord == 0
    assert len({r.section_path for r in got}) == 2 and all(r.token_count > 0 for r in got)


def test_sentence_chunks():
    text = ("A short sentence. " * 80 + "x" * 1700 + ". Tail.")
    got = C.sentence_pieces(text)
    assert "".join(c for _, c in got) == text and all(text.startswith(c, o) for o, c in got)
    assert all(len(c) <= 750 for _, c in got) and C.sentence_pieces("") == []


def test_stores(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, S.upserted(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    for df in (old, new):
        S.publish(df, str(tmp_path / "t"))
    S.publish(old, str(tmp_path / "t"), {"failed": 2})
    assert sorted(map(tuple, S.current(spark, str(tmp_path / "t")).collect())) == [(2, "c"), (3, "d")]
    S.replace_partition(old, str(tmp_path / "p"), "k")
    S.replace_partition(new, str(tmp_path / "p"), "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    jobs = spark.createDataFrame([(1, "x", "running"), (2, "y", "completed")], "job long, book string, status string")
    chunks = spark.createDataFrame([(1, "x", None), (2, "x", "failed"), (3, "x", "done"), (4, "y", None)], "id long, book string, status string")
    assert [tuple(r) for r in L.pending(jobs, chunks).collect()] == [(1, "x", 2, 1)]


@pytest.mark.parametrize("text,want", [("", "## H\n\n- i\n"), ("## H\n- a\n\n## K\n- b\n", "## H\n- a\n- i\n\n## K\n- b\n"), ("x", "x\n\n## H\n\n- i\n")])
def test_section_items(text, want):
    assert S.append_section_item(text, "H", "i") == want


def test_a_book_lies_in_many_tasks(spark):
    """Places are dense over two books whose parts are dealt to several tasks; a part's links stay within it."""
    rows = [(book, part, "s", None, "word. " * (100 * (part % 12))) for book in ("a", None) for part in range(40)]
    parts = spark.createDataFrame(rows, "doc_id string, part long, section_path string, page int, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.sequence(parts)
        assert len({r.task for r in got.select("doc_id", "ord", "prev_ord", F.spark_partition_id().alias("task")).collect() if r.doc_id == "a"}) > 1
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for book in ("a", None):
        n = 0
        for _, _, _, _, text in (r for r in rows if r[0] == book):
            spans = [(a, b) for a, b in C.window_pieces(text) if text[a:b].strip()]
            for k, (a, b) in enumerate(spans):
                want.append((str(book), n + k, a, text[a:b], n + k - 1 if k else None, n + k + 1 if k + 1 < len(spans) else None, n if k else None))
            n += len(spans)
    assert sorted(((str(r.doc_id), r.ord, r.span_start, r.text, r.prev_ord, r.next_ord, r.parent_ord) for r in got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
