"""Queries on libraries, sessions and maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity as A
from ..operators import library as L
from .base import query, table


@query("id_lookup", "select r.k, d.doc_id, d.lang from (select item_id * 7 doc_id, item_id k from benchmark) r join documents d using (doc_id)")
def id_lookup(spark, d):
    ids = table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("doc_id"), F.col("item_id").alias("k"))
    return L.lookup(ids, table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("k", "doc_id", "lang")


@query("optional_filters", "select event_id from events where event_type = 'click' and user_id = 7")
def optional_filters(spark, d):
    return L.when_given(table(spark, d, "events"), event_type="click", user_id=7, props=None).select("event_id")


@query(
    "study_listing",
    """with r as (select c_nationkey study, max(c_acctbal) most, min(c_acctbal) created_at from customer group by c_nationkey), s as (select study, study % 5 = 0 is_active, case when study % 2 = 0 then most end last_opened, created_at from r), b as (select s_nationkey study, count(*) books from supplier group by all)
select study, coalesce(books, 0) books, row_number() over (order by is_active desc, coalesce(last_opened, created_at) desc, study)::int pos from s left join b using (study)""",
)
def study_listing(spark, d):
    raw = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("study")).agg(F.max("c_acctbal").alias("most"), F.min("c_acctbal").alias("created_at"))
    studies = raw.select("study", (F.col("study") % 5 == 0).alias("is_active"), F.when(F.col("study") % 2 == 0, F.col("most")).alias("last_opened"), "created_at")
    out = L.listing(studies, table(spark, d, "supplier").select(F.col("s_nationkey").alias("study")))
    w = Window.orderBy(F.col("is_active").desc(), F.coalesce("last_opened", "created_at").desc(), "study")  # one row a study
    return out.withColumn("pos", F.row_number().over(w)).select("study", "books", "pos")


@query("main_books", "select study, book from (select user_id % 20 study, event_id book, row_number() over (partition by user_id % 20 order by event_type = 'click' desc, ts, event_id) k from events) where k = 1")
def main_books(spark, d):
    books = table(spark, d, "events").select((F.col("user_id") % 20).alias("study"), F.col("event_id").alias("book"), F.when(F.col("event_type") == "click", "main").otherwise("sub").alias("role"), F.col("ts").alias("added_at"))
    return L.main_book(books).select("study", "book")


@query("unique_names", "select p_partkey, case when k = 1 then n else n || ' (' || k || ')' end unique_name from (select p_partkey, p_brand n, row_number() over (partition by p_size, p_brand order by p_partkey) k from part)")
def unique_names(spark, d):
    return L.numbered_names(table(spark, d, "part"), "p_size", "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("bulk_status", "select doc_id id, case when doc_id in (select vec_id from embeddings where label = 3) then 'archived' else 'active' end as status from documents")
def bulk_status(spark, d):
    facts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("active").alias("status"))
    return L.with_status(facts, table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("id")), "archived")


@query("invalidate_book", "select event_id from events where user_id % 9 <> 4")
def invalidate_book(spark, d):
    cache = table(spark, d, "events").select("event_id", (F.col("user_id") % 9).alias("book"))
    gone = spark.createDataFrame([(4,)], "book long")
    return A.cascade(gone, {"responses": (cache, "book")}, "book")["responses"].select("event_id")


@query("retryable_errors", "select event_id, event_type in ('view', 'click') retryable from events")
def retryable_errors(spark, d):
    error = F.when(F.col("event_type") == "view", "HTTP 503").when(F.col("event_type") == "click", "connection reset").otherwise("bad request")
    return table(spark, d, "events").select("event_id", L.retryable(error).alias("retryable"))


@query("like_containment", "select conv_id, turn, text like '%th_%' found from conversations where role = 'user'")
def like_containment(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").like("%th_%").alias("found"))


@query("seeded_sample", "select doc_id from documents where source <> 'src0' order by md5(doc_id || ':7'), doc_id limit 25")
def seeded_sample(spark, d):
    return L.seeded_sample(table(spark, d, "documents").where("source <> 'src0'").select("doc_id"), 25, "doc_id")


@query(
    "alert_messages",
    "select event_type, '능력 착각 신호: ' || case event_type when 'view' then '짧은 체류' else event_type end || ' + 같은 검색 반복 동시 발화' message from (select distinct event_type from events)",
)
def alert_messages(spark, d):
    kind = F.when(F.col("event_type") == "view", "short_dwell").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_type").distinct().select("event_type", L.alert_message(F.concat(kind, F.lit("+repeat_search"))).alias("message"))


@query("last_session", "select study, conv from (select user_id % 20 study, event_id conv, row_number() over (partition by user_id % 20 order by ts desc, event_id desc) k from events) where k = 1")
def last_session(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("study")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("conv"))


@query(
    "similar_turns",
    """with c as (select vec_id, embedding::double[] v, source study, label from embeddings join documents on doc_id = vec_id),
t as (select vec_id turn_id, v qv, study from c where vec_id % 100 = 0),
s as (select turn_id, vec_id chunk_id, round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 6) + 0.0 similarity from t join c using (study) where label <> 3)
select turn_id, chunk_id, similarity from s where similarity >= 0.1""",
)
def similar_turns(spark, d):
    """All embedded chunks of the turn's own study that reach the threshold."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("study"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.when(F.col("label") == 3, "failed").otherwise("done").alias("status"))
    chunks = e.join(docs, "chunk_id")
    turns = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("turn_id"), "study", "vector")
    return L.similar_pairs(turns, chunks.where("status = 'done'"), 0.1, by="study")


@query(
    "first_cited_chunk",
    "select user_id, case when v1 >= 50 then i1 when v2 >= 50 then i2 end chunk_id from (select user_id, value v1, event_id i1, lead(value) over w v2, lead(event_id) over w i2, row_number() over w k from events window w as (partition by user_id order by event_id)) where k = 1",
)
def first_cited_chunk(spark, d):
    """Of the first two rows of a user the first that passes; users without one keep a null."""
    rows = A.latest(table(spark, d, "events"), "user_id", ["event_id"], 2)
    return rows.groupBy("user_id").agg(F.min(F.when(F.col("value") >= 50, F.col("event_id"))).alias("chunk_id"))


@query(
    "study_phases",
    """with l as (select user_id study, event_id id, ts, case when event_type = 'view' then 'stop' when event_type = 'click' then 'start_focus' else 'start_break' end kind from events),
n as (select *, lead(kind) over w nk, lead(ts) over w nt from l window w as (partition by study order by ts, id))
select study, string_split(kind, '_')[2] phase, ts started_at, case when nk = 'stop' then nt end ended_at, coalesce(nk = 'stop', false) completed from n where kind like 'start%'""",
)
def study_phases(spark, d):
    kind = F.when(F.col("event_type") == "view", "stop").when(F.col("event_type") == "click", "start_focus").otherwise("start_break")
    return L.phases(table(spark, d, "events").select(F.col("user_id").alias("study"), F.col("event_id").alias("id"), "ts", kind.alias("kind")))


_HIT = r"regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') in ('with', 'und', 'que')"


@query(
    "search_snippets",
    rf"""with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') w from documents),
m as (select doc_id, w, list_transform(w, lambda x: case when {_HIT} then 1 else 0 end) m from w),
p as (select doc_id, i, list_sum(list_slice(m, i, i + 11)) n from (select doc_id, m, unnest(range(1, len(m) + 1)) i from m) where m[i] = 1),
b as (select doc_id, i a from (select *, row_number() over (partition by doc_id order by n desc, i) k from p) where k = 1),
s as (select w.doc_id, w, coalesce(a, 1) a from w left join b using (doc_id))
select doc_id, case when a > 1 then '…' else '' end || array_to_string(list_transform(list_slice(w, a, a + 11), lambda x: case when {_HIT} then '<<' || x || '>>' else x end), ' ') || case when len(w) > a + 11 then '…' else '' end snippet from s""",
)
def search_snippets(spark, d):
    terms = F.array(F.lit("with"), F.lit("und"), F.lit("que"))
    return table(spark, d, "documents").select("doc_id", L.snippet(F.col("text"), terms).alias("snippet"))


@query(
    "route_outputs",
    "select item_id, case when item_id % 2 = 0 then 'r' || item_id else 'q w e r' end rewrite, case when item_id % 3 = 0 then 'conceptual' else 'balanced' end class from benchmark",
)
def route_outputs(spark, d):
    i = F.col("item_id")
    first = F.when(i % 2 == 0, F.concat(F.lit("Rewrite: r"), i.cast("string"))).otherwise(F.lit("rewrite:"))
    second = F.when(i % 3 == 0, "CLASS: Conceptual").otherwise("class: other")
    rewrite, kind = L.routed(F.concat(first, F.lit("\n"), second), F.lit("q w e r"))
    return table(spark, d, "benchmark").select("item_id", rewrite.alias("rewrite"), kind.alias("class"))


_MODEL = "case event_type when 'view' then 'claude-' || user_id when 'click' then 'gpt-' || user_id when 'error' then 'o3-' || user_id when 'signup' then 'gemini-' || user_id else props end"


@query("provider_backfill", f"select event_id, case when m like 'claude-%' then 'anthropic' when m like 'gpt-%' or m like 'o1-%' or m like 'o3-%' then 'openai' when m like 'gemini-%' then 'gemini' end provider from (select event_id, {_MODEL} m from events)")
def provider_backfill(spark, d):
    return table(spark, d, "events").select("event_id", T.provider_of(F.expr(_MODEL)).alias("provider"))


@query("path_rewrite", "select page_id, replace(url, '/en/', '/english/') url from pages where url like '%/en/%'")
def path_rewrite(spark, d):
    return table(spark, d, "pages").where(F.col("url").like("%/en/%")).select("page_id", F.replace("url", F.lit("/en/"), F.lit("/english/")).alias("url"))


@query("tier_coverage", "select source, count(*) chunks, count(vec_id) embedded from documents left join embeddings on vec_id = doc_id group by source")
def tier_coverage(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id")
    return table(spark, d, "documents").select("doc_id", "source").join(e, "doc_id", "left").groupBy("source").agg(F.count("*").alias("chunks"), F.count("vec_id").alias("embedded"))


@query("cache_hits", "select user_id, coalesce(round(count(*) filter (event_type = 'view') / nullif(count(*), 0), 6), 0) ratio from events group by user_id")
def cache_hits(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.round(F.try_divide(F.count_if(F.col("event_type") == "view"), F.count("*")), 6), F.lit(0.0)).alias("ratio"))
