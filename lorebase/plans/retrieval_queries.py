"""Retrieval queries: each benchmark passage is a question, all of its tokens the terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import fulltext as X
from ..operators import graph as G
from ..operators import library as L
from ..operators import neighbours as N
from ..operators import retrieval as R
from ..session import materialised
from ..sources.snapshots import Snapshot, Store
from . import plugins as P
from .base import query, table
from .plugins import STRENGTH


_INDEXES: dict[tuple[str, str], Store] = {}


def index_of(spark, d: str) -> Snapshot:
    """The full-text index of the documents, written to the shared folder by the session's first search of them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        store = Store.fresh(spark, "fulltext")
        X.build(store, table(spark, d, "documents").select("doc_id", "text"))
        _INDEXES[key] = store
    return _INDEXES[key].snapshot()


def edges_of(spark, d: str) -> DataFrame:
    """(doc_id, entity, weight, rnk, book): the term graph of the documents, stored beside their index by the session's first use of it."""
    index_of(spark, d)
    store = _INDEXES[(spark.sparkContext.applicationId, d)]
    if "edges" not in store.snapshot().tables:
        docs = table(spark, d, "documents")
        store.begin().append("edges", G.entities(docs).join(docs.select("doc_id", F.col("source").alias("book")), "doc_id")).commit()
    return store.read("edges")


def questions(spark, d: str) -> DataFrame:
    """(query_id, unit): the terms of each whole question, as often as it has them."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.chunk_units(F.col("text"))).alias("unit"))


def text_hits(spark, d: str, k: int = R.DEPTH) -> DataFrame:
    return X.search(index_of(spark, d), questions(spark, d), k)


def vector_hits(spark, d: str, k: int = R.DEPTH) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "vector")
    return N.nearest(q, e, k).withColumnRenamed("id", "doc_id")


def chunks(spark, d: str) -> DataFrame:
    """Documents as chunks: the source is the book, a hundred ids a section."""
    return table(spark, d, "documents").withColumn("section_no", F.floor(F.col("doc_id") / 100)).withColumn("token_count", T.token_estimate(F.col("text")))


def links(spark, d: str) -> DataFrame:
    return R.with_links(chunks(spark, d).select("doc_id", "source", "section_no", "token_count"))


TOK = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
_UNITS = """u0 as (select item_id query_id, unnest(string_split_regex(translate(text, '"*^():\\', '       '), '\\s+')) w from benchmark),
u1 as (select query_id, regexp_extract_all(strip_accents(lower(w)), '[\\p{L}\\p{N}]+') toks from u0),
q as (select query_id, toks unit, count(*) times from u1 where len(toks) > 0 group by all)"""
_DOCS = f"dt as (select doc_id, {TOK} ts from documents), tk as (select doc_id, unnest(ts) term, generate_subscripts(ts, 1) pos from dt), dl as (select doc_id, len(ts) len from dt), st as (select count(*) n, avg(len) mean from dl)"
_SCORE = "times * case when ln((n - n_i + 0.5) / (n_i + 0.5)) > 0 then ln((n - n_i + 0.5) / (n_i + 0.5)) else 1e-6 end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))"
_SCORED = f"""df as (select unit, count(*) n_i from fr group by all),
sc as (select query_id, doc_id, round(sum({_SCORE}), 6) score from fr join df using (unit) join q using (unit) join dl using (doc_id), st group by all)"""
_PHRASES = """un as (select distinct unit from q),
fr as (select unit, doc_id, count(*) f from un join tk on term = unit[1] where len(unit) = 1 group by all
 union all select unit, doc_id, count(*) from un join tk on term = unit[1] join dt using (doc_id) where len(unit) > 1 and ts[pos:pos + len(unit) - 1] = unit group by all)"""
_BM25 = f"""{_UNITS}, {_DOCS}, {_PHRASES}, {_SCORED},
bm as (select *, row_number() over (partition by query_id order by score desc, doc_id) rnk from sc)"""
_KNN = """qv as (select vec_id query_id, embedding::double[] qe from embeddings where vec_id in (select item_id from benchmark)),
cs as (select query_id, vec_id doc_id, round(list_dot_product(qe, embedding::double[]) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) + 0.0 score from qv, embeddings),
kn as (select *, row_number() over (partition by query_id order by score desc, doc_id) rnk from cs)"""


@query("postings_stats", f"with tk as (select doc_id, unnest({TOK}) term from documents), p as (select term, doc_id, count(*) tf from tk group by all) select term, count(*) df, sum(tf)::bigint tf from p group by term")
def postings_stats(spark, d):
    """Off the stored index; the session's first full-text query also builds it."""
    return X.statistics(index_of(spark, d))


@query("bm25_topk", f"with {_BM25} select query_id, doc_id, score, rnk::int rnk from bm where rnk <= 20")
def bm25_topk(spark, d):
    return text_hits(spark, d).select("query_id", "doc_id", "score", "rnk")


_STARTS = f"""q as (select query_id, unit, count(*) times from (select item_id query_id, unnest({TOK}) unit from benchmark) group by all), {_DOCS},
tc as (select term tok, doc_id, count(*) c from tk group by all),
vo as (select distinct q.unit, tok from (select distinct unit from q) q join (select distinct tok from tc) t on starts_with(tok, q.unit)),
fr as (select vo.unit, doc_id, sum(c) f from vo join tc using (tok) group by all)"""
_PREFIX = f"{_STARTS}, {_SCORED}"


def prefixes(spark, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.prefix_terms(F.col("text"))).alias("unit"))


@query("bm25_prefix_topk", f"with {_PREFIX} select query_id, doc_id, score, rnk::int rnk from (select *, row_number() over (partition by query_id order by score desc, doc_id) rnk from sc) where rnk <= 5")
def bm25_prefix_topk(spark, d):
    return X.search(index_of(spark, d), prefixes(spark, d), 5, prefix=True).select("query_id", "doc_id", "score", "rnk")


@query(
    "section_search",
    f"""with {_PREFIX}, bk as (select source, right(source, 1) study from (select distinct source from documents)),
rk as (select query_id, doc_id, d.source book, score, row_number() over (partition by query_id order by score desc, doc_id) rnk from sc join documents d using (doc_id) join bk using (source) where bk.study = (query_id % 10)::varchar)
select query_id, doc_id, book, md5(dd.text) text_md5, score, rnk::int rnk from rk join documents dd using (doc_id) where rnk <= 20""",
)
def section_search(spark, d):
    """Full text over sections, their books and the asking study: the sections of its books only, with their text."""
    docs = table(spark, d, "documents")
    books = docs.select("source").distinct().select("source", F.right("source", F.lit(1)).alias("study"))
    scope = docs.join(R.sized(books), "source").select("doc_id", F.col("study").alias("group"))
    hits = X.search(index_of(spark, d), prefixes(spark, d).withColumn("group", (F.col("query_id") % 10).cast("string")), 20, prefix=True, scope=scope)
    few = docs.join(R.sized(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return hits.join(few, "doc_id").select("query_id", "doc_id", F.col("source").alias("book"), F.md5("text").alias("text_md5"), "score", "rnk")


@query(
    "knn_cosine_topk",
    """with q as (select vec_id query_id, embedding::double[] qe from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id id, round(list_dot_product(qe, embedding::double[]) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) + 0.0 score from q, embeddings)
select query_id, id, score, rnk::int rnk from (select *, row_number() over (partition by query_id order by score desc, id) rnk from s) where rnk <= 10""",
)
def knn_cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return N.nearest(e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), e, 10)


_L2 = """with q as (select vec_id query_id, embedding::double[] qe from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id id, round(list_distance(qe, embedding::double[]), 6) + 0.0 dist from q, embeddings {pre}),
g as (select *, row_number() over (partition by query_id order by dist, id) k from s),
b as (select g.query_id, g.id, g.dist from g join documents a on a.doc_id = g.id join documents o on o.doc_id = g.query_id where {lim} a.source = o.source)
select query_id, id, dist, rnk::int rnk from (select *, row_number() over (partition by query_id order by dist, id) rnk from b) where rnk <= 10"""


def _by_book(spark, d, depth: int) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = N.nearest(e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), e, depth, "l2").drop("rnk")
    docs = table(spark, d, "documents")
    own = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("source").alias("book"))
    mine = near.join(docs.select(F.col("doc_id").alias("id"), "source"), "id").join(own, "query_id").where("source = book")
    out = R.ranked(mine.withColumn("near", -F.col("score")), "near", "id", 10)
    return out.select("query_id", "id", F.col("score").alias("dist"), "rnk")


@query("knn_l2_postfilter", _L2.format(pre="", lim="k <= 40 and"))
def knn_l2_postfilter(spark, d):
    """The nearest forty of all, then those of the question's book: a small book may have few left."""
    return _by_book(spark, d, 40)


@query(
    "knn_l2_prefilter",
    """with q as (select vec_id query_id, embedding::double[] qe, source from embeddings join documents on doc_id = vec_id where vec_id % 100 = 0),
s as (select query_id, vec_id id, round(list_distance(qe, embedding::double[]), 6) + 0.0 dist from q join documents d on d.source = q.source join embeddings on vec_id = d.doc_id)
select query_id, id, dist, rnk::int rnk from (select *, row_number() over (partition by query_id order by dist, id) rnk from s) where rnk <= 10""",
)
def knn_l2_prefilter(spark, d):
    """Only vectors of the question's book compete: scored block by block, other books masked."""
    e = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    e = e.select(F.col("vec_id").alias("id"), "source", F.col("embedding").alias("vector"))
    near = N.nearest(e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e, 10, "l2", by="source")
    return near.select("query_id", "id", F.col("score").alias("dist"), "rnk")


_RRF = """rr as (select query_id, doc_id, round(sum(w / (60 + rnk)), 9) rrf_score from (select query_id, doc_id, rnk, {wv} w from kn {j} where rnk <= 20 union all select query_id, doc_id, rnk, {wf} from bm {j} where rnk <= 20) group by all),
rk as (select *, row_number() over (partition by query_id order by rrf_score desc, doc_id) rnk from rr)"""
_HYBRID = f"with {_BM25}, {_KNN}, {_RRF.format(wv='1.0', wf='1.0', j='')}"


def hybrid(spark, d: str) -> DataFrame:
    return R.fuse(vector_hits(spark, d), text_hits(spark, d))


@query("hybrid_rrf", f"{_HYBRID} select query_id, doc_id, rrf_score, rnk::int rnk from rk where rnk <= 10")
def hybrid_rrf(spark, d):
    return hybrid(spark, d).select("query_id", "doc_id", "rrf_score", "rnk")


_ROUTE = r"""case when regexp_matches(q, '`|::|\(\)|->|_|/') or regexp_matches(q, '(^|\s)[A-Za-z0-9_][A-Za-z0-9_.]*\.[A-Za-z0-9_.]*[A-Za-z0-9_]($|\s)') or regexp_matches(q, '["「'']') then 'keyword'
 when regexp_matches(lower(q), '왜|어떻게|무엇|뭐|차이|비교|관계|설명|이유|원리|why|how|what|explain|difference|compare|relationship|concept') and n >= 2 then 'conceptual'
 when n <= 3 and regexp_matches(q, '(^|[^A-Za-z0-9])[A-Z]{2,6}($|[^A-Za-z0-9])') then 'keyword' else 'balanced' end"""
_TRIM = "(select *, trim(text) q, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) n from {t})"


@query(
    "hybrid_rrf_weighted",
    f"""with {_BM25}, {_KNN}, cl as (select item_id query_id, {_ROUTE} c from {_TRIM.format(t="benchmark")}),
we as (select query_id, case c when 'keyword' then 0.7 when 'conceptual' then 1.3 else 1.0 end wv, case c when 'keyword' then 1.3 when 'conceptual' then 0.7 else 1.0 end wf from cl),
{_RRF.format(wv="wv", wf="wf", j="join we using (query_id)")} select query_id, doc_id, rrf_score, rnk::int rnk from rk where rnk <= 10""",
)
def hybrid_rrf_weighted(spark, d):
    v, f = T.route_weights(T.route(F.col("text")))
    weights = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), v.alias("w_vec"), f.alias("w_fts"))
    return R.fuse(vector_hits(spark, d), text_hits(spark, d), weights).select("query_id", "doc_id", "rrf_score", "rnk")


@query("fts_only", f"with {_BM25} select query_id, doc_id, round(1.0 / (60 + rnk), 9) rrf_score, rnk::int rnk from bm where rnk <= 10")
def fts_only(spark, d):
    hits = text_hits(spark, d)
    return R.fuse(hits.limit(0), hits).select("query_id", "doc_id", "rrf_score", "rnk")


@query("query_route", f"select conv_id, turn, {_ROUTE} class from {_TRIM.format(t="conversations")} where role = 'user'")
def query_route(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.route(F.col("text")).alias("class"))


_CHUNKS = """ck as (select *, floor(doc_id / 100) section_no, (length(text) * 30 + 99) // 100 token_count from documents),
ch as (select *, lag(doc_id) over w prev_id, lead(doc_id) over w next_id, nullif(first(doc_id) over w, doc_id) parent_id from ck window w as (partition by source, section_no order by doc_id))"""


@query("chunk_links", f"with {_CHUNKS} select doc_id, parent_id, prev_id, next_id, token_count from ch")
def chunk_links(spark, d):
    return links(spark, d).select("doc_id", "parent_id", "prev_id", "next_id", "token_count")


@query(
    "sentence_window",
    f"""with {_BM25}, {_CHUNKS} select h.query_id, h.doc_id, md5(concat_ws(E'\\n\\n', p.text, c.text, n.text)) window_md5 from bm h join ch c using (doc_id) left join ch p on p.doc_id = c.prev_id left join ch n on n.doc_id = c.next_id where h.rnk <= 10""",
)
def sentence_window(spark, d):
    hits = materialised(text_hits(spark, d, 10).select("query_id", "doc_id"))
    return R.sentence_window(hits, links(spark, d), table(spark, d, "documents")).select("query_id", "doc_id", F.md5("window_text").alias("window_md5"))


_MERGE = f"""{_CHUNKS}, cs2 as (select parent_id, sum(token_count) toks from ch where parent_id is not null group by all),
mg as (select bm.query_id, bm.doc_id, bm.score, bm.rnk, ch.parent_id, count(*) over (partition by bm.query_id, ch.parent_id) c, toks from bm join ch using (doc_id) left join cs2 using (parent_id) where bm.rnk <= 20),
me as (select query_id, case when m then parent_id else doc_id end id, m, score, doc_id, rnk from (select *, coalesce(c >= 2 and toks < 800 and parent_id is not null, false) m from mg)),
mr as (select query_id, id doc_id, round(sum(score), 6) score, list_sort(list(doc_id)) source_chunks, min(rnk)::int pos from me group by query_id, id, m)"""


@query("auto_merge", f"with {_BM25}, {_MERGE} select query_id, doc_id, score, array_to_string(source_chunks, ',') sources, pos from mr")
def auto_merge(spark, d):
    out = R.merge_parents(text_hits(spark, d), links(spark, d))
    return out.select("query_id", "doc_id", "score", F.array_join(F.transform("source_chunks", lambda x: x.cast("string")), ",").alias("sources"), "pos")


_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(
    "mmr_select",
    f"""with recursive {_KNN}, cd as (select query_id, doc_id from kn where rnk <= 12), ve as (select vec_id doc_id, embedding::double[] e from embeddings),
rl as (select query_id, doc_id, {_COS.format(a="e", b="qe")} rel from cd join ve using (doc_id) join qv using (query_id)),
pc as (select a.query_id, a.doc_id x, b.doc_id y, greatest(0.0, {_COS.format(a="v.e", b="w.e")}) s from cd a join cd b using (query_id) join ve v on v.doc_id = a.doc_id join ve w on w.doc_id = b.doc_id),
r as (select distinct query_id, 0 step, []::bigint[] picked from cd
union all select query_id, step + 1, list_append(picked, pick) from (select query_id, step, picked, arg_max(doc_id, (round(0.5 * rel - 0.5 * coalesce(near, 0), 12), rel, -doc_id)) pick from
 (select r.query_id, r.step, r.picked, l.doc_id, l.rel, max(p.s) near from r join rl l on l.query_id = r.query_id left join pc p on p.query_id = r.query_id and p.x = l.doc_id and list_contains(r.picked, p.y) where r.step < 6 and not list_contains(r.picked, l.doc_id) group by all) group by all))
select query_id, unnest(picked) doc_id, unnest(range(1, 7))::int pick from r where step = 6""",
)
def mmr_select(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))
    hits = vector_hits(spark, d, 12).select("query_id", "doc_id", F.col("score").alias("relevance"))
    return R.diverse(hits.join(e, "doc_id", "left").join(q, "query_id", "left"))


_PACK = f"""{_CHUNKS}, pk as (select bm.query_id, bm.doc_id, bm.rnk, ch.text, ch.source, ch.token_count, sum(ch.token_count + 20) over (partition by bm.query_id order by bm.rnk, bm.doc_id) used_tokens from bm join ch using (doc_id) where bm.rnk <= 10),
kp as (select *, row_number() over (partition by query_id order by rnk desc, doc_id desc) marker from pk where used_tokens <= 4000)"""


def packed(spark, d: str) -> DataFrame:
    hits = materialised(text_hits(spark, d, 10).select("query_id", "doc_id", "rnk"))
    few = chunks(spark, d).join(R.sized(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return R.pack(hits.join(few.select("doc_id", "text", "source", "token_count"), "doc_id"), 4000, 20)


@query("context_pack", f"with {_BM25}, {_PACK} select query_id, doc_id, used_tokens::bigint used_tokens, marker::int marker from kp")
def context_pack(spark, d):
    return packed(spark, d).select("query_id", "doc_id", "used_tokens", "marker")


@query(
    "context_markers",
    f"""with {_BM25}, {_PACK} select query_id, md5(string_agg('[S' || marker || '] (책: ' || source || E')\\n' || text, E'\\n\\n' order by marker)) block_md5, string_agg('S' || marker || '=' || doc_id, ',' order by marker) markers, count(*) kept, max(used_tokens)::bigint used_tokens from kp group by query_id""",
)
def context_markers(spark, d):
    none = F.lit(None)
    rows = packed(spark, d).withColumn("block", R.source_block(F.col("marker"), F.col("source"), none.cast("int"), none.cast("string"), F.lit(1), F.col("text")))
    out = R.context(rows)
    pairs = F.array_join(F.transform(F.map_entries("citation_map"), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string"))), ",")
    return out.select("query_id", F.md5("sources_block").alias("block_md5"), pairs.alias("markers"), "kept", "used_tokens")


_LINES = r"""ln as (select doc_id, i, trim(regexp_replace(regexp_replace(l, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g')) l from (select doc_id, unnest(string_split(text, E'\n')) l, unnest(range(len(string_split(text, E'\n')))) i from documents)),
kl as (select * from ln where not regexp_matches(trim(l), '^[-—–·• ]*(?:[0-9]{1,4}|(?:[Pp][Aa][Gg][Ee]|[Pp]\.|[Pp])\s*[0-9]{1,4}|(?:페이지|쪽|면)\s*[0-9]{1,4}|[0-9]{1,4}\s*(?:페이지|쪽|면))[-—–·• ]*$'))"""


@query(
    "passage_clean",
    rf"""with {_LINES}, jn as (select doc_id, regexp_replace(string_agg(l, E'\n' order by i), '\n{{3,}}', E'\n\n', 'g') t from kl group by doc_id),
h as (select doc_id, regexp_replace(regexp_replace(t, '([a-z])- *\n *([a-z])', '\1\2', 'g'), '([a-z])- *\n *([a-z])', '\1\2', 'g') t from jn)
select d.doc_id, md5(coalesce(regexp_replace(t, '^[ \n]+|[ \n]+$', '', 'g'), '')) clean_md5 from documents d left join h using (doc_id)""",
)
def passage_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_passage(F.col("text"))).alias("clean_md5"))


_MENU = "array_to_string(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), chr(10))"


@query(
    "boilerplate_lines",
    rf"""with p as (select page_id doc_id, regexp_extract(html, 'lang="([a-z]+)"', 1) lang, {_MENU} as text from pages),
ln as (select doc_id, lang, trim(regexp_replace(regexp_replace(l, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g')) line from (select doc_id, lang, unnest(string_split(text, E'\n')) l from p))
select lang, line, count(distinct doc_id) passages from ln where line <> '' and length(line) <= 60 and not regexp_matches(line, '([.!?。！？]|다)$') group by all having count(distinct doc_id) >= 3""",
)
def boilerplate_lines(spark, d):
    """The menu entries that pages of a language share."""
    entries = F.array_join(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)), "\n")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), entries.alias("text"))
    return R.boilerplate(pages, scope="lang")


_STOPS = ",".join(f"'{w}'" for w in (*G.PARTICLES, *G.STOPS))
_ENT = f"""en as (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[가-힣]+'))) entity from documents),
ec as (select doc_id, entity, count(*) weight from en where length(entity) >= 2 and not regexp_matches(entity, '^[0-9]+$') and entity not in ({_STOPS}) group by all),
et as (select * from (select *, row_number() over (partition by doc_id order by weight desc, entity) rnk from ec) where rnk <= 10)"""


@query("entity_topk", f"with {_ENT} select doc_id, entity, weight, rnk::int rnk from et")
def entity_topk(spark, d):
    return G.entities(table(spark, d, "documents"))


@query(
    "entity_expand",
    f"""with {_BM25}, {_ENT}, ed as (select source book, et.* from et join documents using (doc_id)), sd as (select distinct query_id, doc_id from bm where rnk <= 10),
ow as (select query_id, book, entity, sum(weight) w from sd join ed using (doc_id) group by all),
tp as (select * from (select *, row_number() over (partition by query_id order by w desc, entity, book) k from ow) where k <= 12),
nb as (select query_id, ed.doc_id, sum(weight) strength from tp join ed using (book, entity) where (query_id, ed.doc_id) not in (select query_id, doc_id from sd) group by all)
select query_id, doc_id, strength::bigint strength, rnk::int rnk from (select *, row_number() over (partition by query_id order by strength desc, doc_id) rnk from nb) where rnk <= 2""",
)
def entity_expand(spark, d):
    return G.expand(materialised(text_hits(spark, d, 10).select("query_id", "doc_id")), edges_of(spark, d))


def study_books(spark, d: str) -> DataFrame:
    """(study, book): the book that a study's questions go to; a source is a book, main if it has English texts, added with its first one."""
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("book")).agg(F.min("doc_id").alias("added_at"), F.when(F.max(F.col("lang") == "en"), "main").otherwise("sub").alias("role"))
    return L.main_book(rows.withColumn("study", F.right("book", F.lit(1)))).select("study", "book")


def within_book(hits: DataFrame, books: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Of ``hits(query_id, doc_id, score)``, best first by ``score``, the k best of the question's book."""
    own = hits.join(books, "doc_id").join(R.sized(asked.select("query_id", "book")), ["query_id", "book"])
    return R.ranked(own, "score", "doc_id", k)


def answers(spark, d: str, strength: str = "balanced", generator=None, embedder=None) -> DataFrame:
    """(query_id, sources_block, kept, used_tokens): retrieval in the study's book, then what ``strength`` says, then packing and citing.

    In order: rewrite the question; search its book by text (the rewritten question) and by vector (the
    hypothetical answer, if there is one); fuse the ten best; add two neighbours of the term graph; widen to the
    neighbours in the section, replace siblings by their parent (whose own text counts), keep the six most
    diverse; clean; pack 4,000 tokens, each source with 24 more if siblings were merged at this strength, else
    20. With ``embedder`` vectors are made of these texts, for diversity the mean of question and
    hypothetical answer; without one a question has the stored vector of its id.
    """
    steps = STRENGTH[strength]
    docs, books = table(spark, d, "documents"), table(spark, d, "documents").select("doc_id", F.col("source").alias("book"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 10).cast("string").alias("study"))
    asked = materialised(asked.join(R.sized(study_books(spark, d)), "study"))
    if "rewrite" in steps:
        asked = asked.withColumn("text", P.rewritten(F.col("text"), P.generated(F.col("text"), generator)))
    guess = P.hypothetical(F.col("text"), P.generated(F.col("text"), generator)) if "hyde" in steps else F.col("text")
    asked = materialised(asked.withColumn("guess", guess))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    if embedder:
        asked = asked.withColumn("vector", P.embedded(F.col("guess"), embedder))
        asked = materialised(asked.withColumn("query_vector", V.mean(P.embedded(F.col("text"), embedder), F.col("vector")) if "hyde" in steps else F.col("vector")))
    else:
        asked = materialised(asked.join(e.withColumnRenamed("doc_id", "query_id"), "query_id", "left").withColumn("query_vector", F.col("vector")))
    near = N.nearest(asked.select("query_id", "vector"), e.withColumnRenamed("doc_id", "id"), 4 * R.DEPTH).withColumnRenamed("id", "doc_id").drop("rnk")
    units = asked.select("query_id", F.col("book").alias("group"), F.explode(T.chunk_units(F.col("text"))).alias("unit"))
    found = X.search(index_of(spark, d), units, R.DEPTH, scope=books.withColumnRenamed("book", "group"))
    hits = materialised(R.fuse(within_book(near, books, asked, R.DEPTH), found).select("query_id", "doc_id", F.col("rrf_score").alias("score"), "rnk"))
    if "expand" in steps:
        own = edges_of(spark, d).join(R.sized(asked.select("book").distinct()), "book", "left_semi")
        hits = materialised(R.ranked(G.append(hits, G.expand(hits, own)), "score", "doc_id", R.TOP + G.NEIGHBOURS))
    merged = "merge" in steps
    rows = R.merge_parents(hits, links(spark, d)).withColumnRenamed("pos", "rnk") if merged else hits.withColumn("source_chunks", F.array("doc_id"))
    rows = materialised(rows)
    if "diverse" in steps:
        pool = rows.select("query_id", "doc_id", F.col("score").alias("relevance")).join(e, "doc_id", "left").join(asked.select("query_id", "query_vector"), "query_id", "left")
        rows = materialised(rows.drop("rnk").join(R.diverse(pool).withColumnRenamed("pick", "rnk"), ["query_id", "doc_id"]))
    few = rows.select("query_id", "doc_id", "rnk", F.size("source_chunks").alias("n_sources"))
    if "window" in steps:  # a parent's text is its own
        wide = R.sentence_window(few.where("n_sources < 2"), links(spark, d), docs).withColumnRenamed("window_text", "text")
        few = wide.unionByName(R.with_texts(few.where("n_sources >= 2"), docs))
    else:
        few = R.with_texts(few, docs)
    places = chunks(spark, d).select("doc_id", "source", F.col("section_no").cast("string").alias("section"), "token_count")
    few = materialised(few.join(places.join(R.sized(rows.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id"))
    kept = R.pack(R.clean_passages(few, renew=merged), 4000, 24 if merged else 20)
    kept = kept.withColumn("block", R.source_block(F.col("marker"), F.col("source"), F.lit(None).cast("int"), F.col("section"), F.col("n_sources"), F.col("text")))
    return R.context(kept).select("query_id", "sources_block", "kept", "used_tokens")


_BOOK = f"""{_UNITS}, {_DOCS}, {_PHRASES}, {_SCORED},
bk as (select source book, min(doc_id) added_at, case when bool_or(lang = 'en') then 0 else 1 end sub, right(source, 1) study from documents group by source),
mb as (select study, book from (select *, row_number() over (partition by study order by sub, added_at, book) k from bk) where k = 1),
aq as (select item_id query_id, book from benchmark join mb on study = (item_id % 10)::varchar),
bm as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) rnk from sc join documents using (doc_id) join aq using (query_id) where source = book),
{_KNN.replace("kn as (", "k0 as (")},
kn as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) rnk from k0 join documents using (doc_id) join aq using (query_id) where source = book and rnk <= 80),
rr as (select query_id, doc_id, round(sum(1.0 / (60 + rnk)), 9) score from (select query_id, doc_id, rnk from kn where rnk <= 20 union all select query_id, doc_id, rnk from bm where rnk <= 20) group by all),
sd as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rnk from rr) where rnk <= 10),
{_ENT}, ed as (select source book, et.* from et join documents using (doc_id)),
ow as (select query_id, book, entity, sum(weight) w from sd join ed using (doc_id) group by all),
tp as (select * from (select *, row_number() over (partition by query_id order by w desc, entity, book) k from ow) where k <= 12),
nb as (select query_id, ed.doc_id, sum(weight) strength from tp join ed using (book, entity) where (query_id, ed.doc_id) not in (select query_id, doc_id from sd) group by all),
nn as (select * from (select *, row_number() over (partition by query_id order by strength desc, doc_id) rnk from nb) where rnk <= 2),
ah as (select query_id, doc_id, score from sd union all select query_id, doc_id, round(greatest(lo * 0.9, 1e-6) * strength / most, 9) from nn join (select query_id, min(score) lo from sd group by all) using (query_id) join (select query_id, max(strength) most from nn group by all) using (query_id)),
al as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rnk from ah) where rnk <= 12)"""
_CLEANED = rf"""{_LINES}, no as (select query_id, l from ln join al using (doc_id) where l <> '' and length(l) <= 60 and not regexp_matches(l, '([.!?。！？]|다)$') group by all having count(distinct doc_id) >= 3),
jn as (select query_id, doc_id, regexp_replace(string_agg(l, E'
' order by i), '
{{3,}}', E'

', 'g') t from al join kl using (doc_id) left join no using (query_id, l) where no.query_id is null group by all),
hy as (select query_id, doc_id, regexp_replace(regexp_replace(t, '([a-z])- *
 *([a-z])', '', 'g'), '([a-z])- *
 *([a-z])', '', 'g') t from jn),
ct as (select query_id, doc_id, rnk, source, text, coalesce(regexp_replace(t, '^[ 
]+|[ 
]+$', '', 'g'), '') t from al join documents using (doc_id) left join hy using (query_id, doc_id)),
fi as (select query_id, doc_id, rnk, source, case when trim(t) = '' then text else t end t, (length(text) * 30 + 99) // 100 raw from ct)"""


@query("answer_contexts")
def answer_contexts(spark, d):
    """The whole path at balanced strength."""
    return answers(spark, d)


@query(
    "answer_fast",
    f"""with {_BOOK}, {_CLEANED}, pk as (select *, sum(raw + 20) over (partition by query_id order by rnk, doc_id) used from fi),
kp as (select *, row_number() over (partition by query_id order by rnk desc, doc_id desc) marker from pk where used <= 4000)
select query_id, string_agg('[S' || marker || '] (책: ' || source || ', §' || (doc_id // 100) || E')\n' || t, E'\n\n' order by marker) sources_block, count(*) kept, max(used)::bigint used_tokens from kp group by query_id""",
)
def answer_fast(spark, d):
    """At the fast strength: the ten best of the book and two neighbours, cleaned, packed raw."""
    return answers(spark, d, "fast")
