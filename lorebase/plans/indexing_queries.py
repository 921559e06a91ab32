"""Queries on indexes, caches, queues and streams of work kept in step with their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import activity as A
from ..operators import chunking, triggers
from ..operators import fulltext as X
from ..operators import graph as G
from ..operators import indexing as I
from ..operators import library as L
from ..operators import neighbours as N
from ..operators import retrieval as R
from ..session import materialised
from ..sources.snapshots import Store
from .activity_queries import _signals
from .base import query, table
from .plugins import hash_embedder
from .retrieval_queries import _BM25, _ENT, _PREFIX, TOK, edges_of, index_of, prefixes, questions, text_hits
from .text_queries import _WINDOWS


@query(
    "cache_read_through",
    """with e as (select event_type || (user_id % 50) as key, event_id id, ts, coalesce(ts - lag(ts) over w <= interval 1 hour, false) hit, upper(props) made from events window w as (partition by event_type || (user_id % 50) order by ts, event_id)),
g as (select *, count(*) filter (not hit) over (partition by key order by ts, id) run from e)
select key, id, hit, first_value(made) over (partition by key, run order by ts, id) as value from g""",
)
def cache_read_through(spark, d):
    """A cache whose values live an hour from their last use; what is missed is made of the row's own text."""
    key = F.concat("event_type", (F.col("user_id") % 50).cast("string"))
    log = table(spark, d, "events").select(key.alias("key"), F.col("event_id").alias("id"), "ts", F.col("props").alias("text"))
    return I.read_through(log, F.upper, 3600).select("key", "id", "hit", "value")


_CHANGED = "nd as (select doc_id, case when doc_id % 7 = 0 then text || ' Réécrit' else text end as text from documents where doc_id % 11 <> 0)"


def refreshed_index(spark, d):
    """The index of the documents after deletions and rewrites: only the blocks of touched documents are made anew.

    It begins as the session's index, which stays as it is; what the changes here have replaced is removed.
    """
    docs, store = table(spark, d, "documents").select("doc_id", "text"), Store.forked(index_of(spark, d), "fulltext")
    now = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" Réécrit"))).otherwise(F.col("text")))
    X.refresh(store, now, docs.where("doc_id % 11 = 0 or doc_id % 7 = 0").select("doc_id"))
    store.expire()
    return store


@query("postings_refresh", f"with {_CHANGED}, tk as (select doc_id, unnest({TOK}) term from nd) select term, count(distinct doc_id) df, count(*) tf from tk group by term")
def postings_refresh(spark, d):
    return X.statistics(refreshed_index(spark, d).snapshot())


@query("refreshed_topk", f"with {_CHANGED}, {_BM25.replace('from documents', 'from nd')} select query_id, doc_id, score, rnk::int rnk from bm where rnk <= 20")
def refreshed_topk(spark, d):
    """A search of the refreshed index, compacted: what was deleted or rewritten counts in no statistic."""
    store = refreshed_index(spark, d)
    X.compact(store)
    store.expire()
    return X.search(store.snapshot(), questions(spark, d), R.DEPTH).select("query_id", "doc_id", "score", "rnk")


@query("link_upsert", "select fact_id, chunk_id, similarity from (select user_id fact_id, event_id % 50 chunk_id, value similarity, row_number() over (partition by user_id, event_id % 50 order by ts desc, event_id % 2 desc) k from events) where k = 1")
def link_upsert(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("fact_id"), (F.col("event_id") % 50).alias("chunk_id"), F.col("value").alias("similarity"), "ts", "event_id")
    out = I.replaced(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"), ["fact_id", "chunk_id"], "ts")
    return out.select("fact_id", "chunk_id", "similarity")


@query(
    "embedding_put",
    """with c as (select distinct sha256(text || ':e5') key from documents where doc_id % 2 = 0), n as (select distinct sha256(text || ':e5') key from documents where doc_id % 3 = 0)
select key, case when c.key is not null then timestamp '2024-01-01' else timestamp '2024-02-01' end created, case when n.key is not null then timestamp '2024-02-01' else timestamp '2024-01-01' end last_hit from c full join n using (key)""",
)
def embedding_put(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.embedding_key(F.col("text"), F.lit("e5")).alias("key"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    cache = rows.where("doc_id % 2 = 0").select("key", "embedding").dropDuplicates(["key"]).withColumn("created", day("2024-01-01")).withColumn("last_hit", F.col("created"))
    new = rows.where("doc_id % 3 = 0").select("key", "embedding").dropDuplicates(["key"])
    return I.cache_put(cache, new, day("2024-02-01"), 2).select("key", "created", "last_hit")


@query(
    "response_put",
    """with r as (select conv_id, turn, sha256(concat_ws(chr(31), 'b' || (conv_id % 5), text, array_to_string(list_sort([turn, conv_id]), ','), 'm')) key from conversations where role = 'user'),
c as (select distinct key from r where turn = 0), n as (select distinct key from r where conv_id % 2 = 0)
select key, case when c.key is not null then timestamp '2024-01-01' else timestamp '2024-02-01' end created, case when n.key is not null then timestamp '2024-02-01' else timestamp '2024-01-01' end last_hit from c full join n using (key)""",
)
def response_put(spark, d):
    key = T.response_key(F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")), F.col("text"), F.array("turn", "conv_id"), F.lit("m"))
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", key.alias("key"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    cache = rows.where("turn = 0").select("key").distinct().withColumn("created", day("2024-01-01")).withColumn("last_hit", F.col("created"))
    return I.cache_put(cache, rows.where("conv_id % 2 = 0").select("key").distinct(), day("2024-02-01"))


class _Brittle:
    """An embedder that fails on long texts, with the batch they are in."""

    def __call__(self, texts):
        if any(len(t) > 3000 for t in texts):
            raise ValueError("too long")
        return hash_embedder(8)(texts)


@query(
    "embed_progress",
    """with c as (select *, case doc_id % 5 when 0 then 'done' when 1 then 'failed' end status, doc_id % 4 attempts from documents),
k as (select distinct text from documents where doc_id % 3 = 0),
o as (select source book, k.text is not null cached, k.text is not null or (trim(c.text, E' \\t\\n\\r') <> '' and length(c.text) <= 3000) done, attempts from c left join k on k.text = c.text where status is null or status = 'failed')
select book, count(*) chunks, count(*) filter (done) done, count(*) filter (not done and attempts + 1 >= 3) failed, count(*) filter (not done and attempts + 1 < 3) pending, count(*) filter (cached) cached from o group by book""",
)
def embed_progress(spark, d):
    """Pending chunks through cache and model in batches: what is done, failed and left in each book."""
    docs = table(spark, d, "documents")
    status = F.when(F.col("doc_id") % 5 == 0, "done").when(F.col("doc_id") % 5 == 1, "failed")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book"), "text", status.alias("status"), (F.col("doc_id") % 4).alias("attempts"))
    known = F.array_repeat(F.lit(0.125).cast("float"), 8)
    cache = docs.where("doc_id % 3 = 0").select(T.embedding_key(F.col("text"), F.lit("t1")).alias("key")).distinct().withColumn("embedding", known)
    return I.progress(I.embed_pending(chunks, cache, _Brittle, "t1", 8))


_ALERTS = """s as (select user_id % 20 study, event_type t, event_id id, ts, epoch(date_trunc('second', ts))::bigint sec from events where event_id % 10 <> 0),
a as (select x.study, x.id, x.ts, array_to_string(list_sort(list_distinct(list(y.t))), '+') combo, len(list_distinct(list(y.t)))::int n_types from s x join s y on y.study = x.study and y.sec between x.sec - 300 and x.sec group by all)"""
_COOLED = """e as (select *, row_number() over (partition by study, combo order by ts, id) n from a where n_types >= 2),
r as (select study, combo, id, ts, n_types, n, ts as last, true as pass from e where n = 1
union all select e.study, e.combo, e.id, e.ts, e.n_types, e.n, case when e.ts >= r.last + interval 1800 second then e.ts else r.last end, e.ts >= r.last + interval 1800 second from r join e on e.study = r.study and e.combo = r.combo and e.n = r.n + 1)"""


@query("alert_cooldown", f"with recursive {_ALERTS}, {_COOLED} select study, id, ts, combo from r where pass")
def alert_cooldown(spark, d):
    return A.cooled_alerts(A.alerts(_signals(spark, d))).select("study", "id", "ts", "combo")


@query(
    "metacog_chain",
    f"""with recursive g as (select user_id % 20 study, event_id id, ts, epoch(date_trunc('second', ts))::bigint sec, (event_id % 100) / 100 c, (user_id % 100) / 100 p, event_type = 'purchase' said from events),
s as (select study, id, ts, sec, 'progress_recall_gap' t from g where round(abs(c - p), 9) >= 0.3 union all select study, id, ts, sec, 'self_report_low' from g where said and c <= 0.4),
a as (select x.study, x.id, x.ts, array_to_string(list_sort(list_distinct(list(y.t))), '+') combo, len(list_distinct(list(y.t)))::int n_types from (select distinct study, id, ts, sec from s) x join s y on y.study = x.study and y.sec between x.sec - 300 and x.sec group by all),
{_COOLED} select study, id, '능력 착각 신호: 진도-회상 격차 + 자기보고-실제 격차 동시 발화' content, round(n_types / 5, 6) confidence from r where pass""",
)
def metacog_chain(spark, d):
    """What each turn tells of misjudged ability: signals, alerts where two meet, once a cooldown, kept as facts."""
    text = F.when(F.col("event_type") == "purchase", F.concat(F.lit("I know this "), "props")).otherwise(F.col("props"))
    turns = table(spark, d, "events").select((F.col("user_id") % 20).alias("study"), F.col("event_id").alias("id"), "ts", text.alias("text"), ((F.col("event_id") % 100) / 100).alias("citation"), ((F.col("user_id") % 100) / 100).alias("progress"))
    fired = A.cooled_alerts(A.alerts(A.metacog_signals(turns)).dropDuplicates(["study", "id", "ts"]))
    return A.alert_facts(fired, L.alert_message(F.col("combo"))).select("study", "id", "content", "confidence")


@query("sections_in_order", "select source, section_no, row_number() over (partition by source order by first, section_no)::int pos from (select source, doc_id // 100 section_no, min(doc_id) first from documents group by all)")
def sections_in_order(spark, d):
    rows = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 100).alias("section_no"), F.col("doc_id").alias("ord"))
    return L.reading_order(rows, "source", "section_no", "ord").select("source", "section_no", "pos")


@query(
    "citation_mean",
    """with m as (select event_id id, event_id % 7 = 0 broken, (event_id % 10) / 10 s from events order by event_id desc limit 50) select round(avg(s), 6) citation_mean from m where not broken""",
)
def citation_mean(spark, d):
    from .activity_queries import _contexts

    return A.citation_accuracy(_contexts(spark, d), 50).select(F.col("avg_score").alias("citation_mean"))


@query(
    "graph_append",
    f"""with {_BM25}, {_ENT}, ed as (select source book, et.* from et join documents using (doc_id)), sd as (select query_id, doc_id, score from bm where rnk <= 10),
ow as (select query_id, book, entity, sum(weight) w from sd join ed using (doc_id) group by all),
tp as (select * from (select *, row_number() over (partition by query_id order by w desc, entity, book) k from ow) where k <= 12),
nb as (select query_id, ed.doc_id, sum(weight) strength from tp join ed using (book, entity) where (query_id, ed.doc_id) not in (select query_id, doc_id from sd) group by all),
nn as (select * from (select *, row_number() over (partition by query_id order by strength desc, doc_id) rnk from nb) where rnk <= 2)
select query_id, doc_id, round(score, 6) score from sd union all select query_id, doc_id, round(greatest(lo * 0.9, 1e-6) * strength / most, 6) from nn join (select query_id, min(score) lo from sd group by all) using (query_id) join (select query_id, max(strength) most from nn group by all) using (query_id)""",
)
def graph_append(spark, d):
    hits = materialised(text_hits(spark, d, 10).select("query_id", "doc_id", "score"))
    return G.append(hits, materialised(G.expand(hits, edges_of(spark, d)))).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    "mixed_vectors",
    """with q as (select a.vec_id query_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: ((x[1] + x[2]) / 2)::float)::double[] qe from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 100 = 0),
s as (select query_id, vec_id id, round(list_dot_product(qe, embedding::double[]) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) + 0.0 score from q, embeddings)
select query_id, id, score, rnk::int rnk from (select *, row_number() over (partition by query_id order by score desc, id) rnk from s) where rnk <= 5""",
)
def mixed_vectors(spark, d):
    """A question's vector and that of a hypothetical answer, in the middle between the two."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    answers = e.select((F.col("id") - 1).alias("id"), F.col("vector").alias("answer"))
    q = e.where("id % 100 = 0").join(answers, "id").select(F.col("id").alias("query_id"), V.mean(F.col("vector"), F.col("answer")).alias("vector"))
    return N.nearest(q, e, 5)


@query(
    "turn_window",
    """with q as (select conv_id, arg_max(text, turn) question from conversations where role = 'user' group by conv_id),
m as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) back from conversations join q using (conv_id) where text <> question)
select conv_id, turn, role from m where back <= 6""",
)
def turn_window(spark, d):
    """The last three turns before each conversation's last question, that question itself left out."""
    c = table(spark, d, "conversations")
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return A.recent(c, 6, asked).select("conv_id", "turn", "role")


@query(
    "history_window",
    """with m as (select distinct client_id conv_id, sale_id turn, coalesce(status, '-') || ' ' || coalesce(priority, 0) as text from sales where client_id is not null and sale_id is not null),
o as (select conv_id, turn, min(text) as text from m group by all),
c as (select *, row_number() over (partition by conv_id order by turn desc) back, count(*) over (partition by conv_id) n from o)
select conv_id, count(*) filter (n <= 6 or back <= 12) raw, coalesce(md5(string_agg(text, ' ' order by turn) filter (n > 6 and back > 12)), '') older_md5 from c group by conv_id""",
)
def history_window(spark, d):
    """Short histories raw; of longer ones the last messages raw and what lies before as one summary's input. A client's sales are the messages."""
    text = F.concat(F.coalesce("status", F.lit("-")), F.lit(" "), F.coalesce("priority", F.lit(0)).cast("string"))
    m = table(spark, d, "sales").where("client_id is not null and sale_id is not null").groupBy(F.col("client_id").alias("conv_id"), F.col("sale_id").alias("turn")).agg(F.min(text).alias("text"))
    out = A.split_history(m)
    return out.select("conv_id", "raw", F.when(F.col("older") == "", "").otherwise(F.md5("older")).alias("older_md5"))


@query(
    "session_choice",
    "select c_custkey study, coalesce(cast(conv as varchar), 'new-' || c_custkey) session, conv is null created from customer left join (select user_id, arg_max(event_id, (ts, event_id)) conv from events group by user_id) on user_id = c_custkey",
)
def session_choice(spark, d):
    sessions = table(spark, d, "events").select(F.col("user_id").alias("study"), F.col("event_id").cast("string").alias("session"), F.col("ts").alias("updated_at"), F.col("event_id").alias("id"))
    return L.latest_or_new(table(spark, d, "customer").select(F.col("c_custkey").alias("study")), sessions)


@query(
    "free_names",
    """with t as (select distinct p_brand n, p_size z from part where p_partkey % 3 = 0), r as (select distinct p_brand n, p_size z from part where p_partkey % 3 <> 0)
select r.z p_size, r.n p_brand, case when t.n is null then r.n else r.n || ' (2)' end free from r left join t using (n, z)""",
)
def free_names(spark, d):
    part = table(spark, d, "part").select("p_size", "p_brand")
    p = table(spark, d, "part")
    taken = p.where("p_partkey % 3 = 0").select("p_size", F.col("p_brand").alias("name")).distinct()
    return L.free_names(p.where("p_partkey % 3 <> 0").select(*part.columns).distinct(), taken, "p_size", "p_brand").select("p_size", "p_brand", "free")


@query("status_changes", "select label, count(*) affected from embeddings join documents on doc_id = vec_id where label < 4 group by label")
def status_changes(spark, d):
    """How many rows a bulk change of status reaches, by the group that asked for it."""
    ids = table(spark, d, "embeddings").where("label < 4").select(F.col("vec_id").alias("id"), "label")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("active").alias("status"))
    return L.affected(rows, ids, "archived", "label")


@query("content_edits", "select conv_id, turn, md5(case when role = 'user' and turn = 0 then text || ' (edited)' else text end) content_md5, role = 'user' and turn = 0 edited from conversations")
def content_edits(spark, d):
    c = table(spark, d, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    edits = c.where("role = 'user' and turn = 0").select("id", F.concat("text", F.lit(" (edited)")).alias("new_text"))
    return L.edited(c, edits, "text").select("conv_id", "turn", F.md5("text").alias("content_md5"), "edited")


@query(
    "token_replay",
    "select conv_id handle, md5(string_agg(text, '' order by turn)) text_md5, count(*) n_tokens, bool_or(turn = 3) finished from conversations group by conv_id",
)
def token_replay(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("handle"), F.col("turn").alias("seq"), F.lit("delta").alias("kind"), F.col("text").alias("delta"))
    done = c.where("seq = 3").select("handle", "seq", F.lit("done").alias("kind"), F.lit(None).cast("string").alias("delta"))
    out = I.replayed(c.union(done))
    return out.select("handle", F.md5("text").alias("text_md5"), "n_tokens", "finished")


@query(
    "worker_states",
    """with e as (select user_id worker, event_id id, ts, case when event_type = 'click' then 'resume' else 'pause' end kind, event_id % 2 owner from events),
h as (select worker, id, ts, owner, (kind = 'pause')::int held from e),
c as (select *, held - coalesce(lag(held) over (partition by worker, owner order by ts, id), 0) step from h)
select worker, id, sum(step) over (partition by worker order by ts, id rows unbounded preceding) = 0 running from c""",
)
def worker_states(spark, d):
    e = table(spark, d, "events")
    return I.paused(e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "click", "resume").otherwise("pause").alias("kind"), (F.col("event_id") % 2).alias("owner")))


@query(
    "span_times",
    """with e as (select user_id trace, event_id % 3 as name, event_id id, ts, case event_type when 'view' then 'begin' when 'click' then 'end' else 'note' end kind from events),
n as (select *, count(*) filter (kind = 'begin') over (partition by trace, name order by ts, id) n from e)
select trace, name, n, round((epoch_us(min(ts) filter (kind = 'end')) - epoch_us(min(ts) filter (kind = 'begin'))) / 1000, 3) ms, count(*) filter (kind = 'note') notes from n where n > 0 group by all""",
)
def span_times(spark, d):
    kind = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "click", "end").otherwise("note")
    return I.trace(table(spark, d, "events").select(F.col("user_id").alias("trace"), (F.col("event_id") % 3).alias("name"), kind.alias("kind"), F.col("event_id").alias("id"), "ts"))


# One sentence an item, whose size chooses what it asks for; the other columns are what it is about.
_SAID = """case size % 8 when 0 then '이제부터 ' || name || ' 써줘. 끝' when 1 then kind || ', 앞으로는 ' || brand || ' 먼저' when 2 then name || ' 스타일로 해줘'
 when 3 then name || ' 하지 말아줘' when 4 then '그러지 마, ' || name when 5 then brand || ' ' || kind || ' 빼줘' when 6 then brand || '까지 끝내고 싶어' else name || ' ' || brand end"""
# The whole patterns, in order of precedence.
_PATTERNS = (
    ("preference", r"(?:^|\n|\s)이제부터\s+(.+?)(?:[.,!?]|$|\n)"),
    ("preference", r"(?:^|\n|\s)앞으로(?:는)?\s+(.+?)(?:[.,!?]|$|\n)"),
    ("preference", r"(.+?)\s*스타일로\s+(?:가자|해줘|부탁)"),
    ("correction", r"(.+?)\s*하지\s*말아?\s*줘"),
    ("correction", r"(그러지\s*마)"),
    ("correction", r"(.+?)\s*빼줘"),
    ("goal", r"(.+?)(?:까지|을|를)\s*(?:끝내고\s*싶|목표야|마치고\s*싶)"),
)


@query(
    "trigger_detect",
    f"with t as (select item_id, {_SAID} as text from items) "
    + " union all ".join(f"select item_id, '{kind}' as kind, trim(regexp_extract(text, '{p}')) as matched, trim(regexp_extract(text, '{p}', 1)) as entry from t where regexp_matches(text, '{p}')" for kind, p in _PATTERNS),
)
def trigger_detect(spark, d):
    """Memory triggers in a sentence on each item; no sentence has two."""
    t = table(spark, d, "items").select("item_id", triggers.triggers(F.expr(_SAID)).alias("t"))
    return t.select("item_id", F.inline("t"))


@query(
    "indexed_books",
    f"""with recursive {_WINDOWS}, c as (select source book, wi.text from wi join documents using (doc_id)),
p as (select book, count(distinct term) terms from (select book, unnest({TOK}) term from c) group by book)
select book, count(*) chunks, (count(*) - 1)::int last_ord, sum((length(text) * 30 + 99) // 100)::bigint tokens, any_value(terms) terms, count(*) vectors from c join p using (book) group by book""",
)
def indexed_books(spark, d):
    """From sections to an index: chunks of whole texts in order, their terms and vectors, counted for each book."""
    docs = table(spark, d, "documents")
    parts = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("part"), F.lit(None).cast("string").alias("section_path"), F.lit(None).cast("int").alias("page"), "text")
    chunks = chunking.sequence(parts)
    rows = chunks.select(F.struct("doc_id", "ord").alias("chunk_id"), F.col("doc_id").alias("book"), "text", F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("attempts"))
    cache = spark.createDataFrame([], "key string, embedding array<float>")
    done = I.progress(I.embed_pending(rows, cache, lambda: hash_embedder(8), "t1", 8)).select("book", F.col("done").alias("vectors"))
    index = I.postings(rows.select(F.col("chunk_id").alias("doc_id"), "text")).groupBy(F.col("doc_id.doc_id").alias("book")).agg(F.countDistinct("term").alias("terms"))
    out = chunks.groupBy(F.col("doc_id").alias("book")).agg(F.count("*").alias("chunks"), F.max("ord").alias("last_ord"), F.sum("token_count").alias("tokens"))
    return out.join(index, "book").join(done, "book")


@query(
    "context_fallback",
    f"""with {_BM25}, h as (select query_id, min(doc_id) filter (rnk = 1 and score >= 150) hit from bm group by query_id),
fs as (with {_PREFIX} select query_id, string_agg(doc_id::varchar, ',' order by rnk) sections from (select *, row_number() over (partition by query_id order by score desc, doc_id) rnk from sc) where rnk <= 5 group by query_id),
c as (select item_id query_id, h.hit, s.text section, fs.sections, f.file from benchmark left join h on h.query_id = item_id left join (select doc_id, text from documents where text is not null and lang = 'en') s on s.doc_id = item_id left join fs on fs.query_id = item_id left join (select min(source) file from documents) f on item_id % 2 = 0)
select query_id, case when hit is not null then 'hybrid' when section is not null then 'section' when sections is not null then 'section_search' when file is not null then 'file' else 'none' end kind, coalesce(hit::varchar, md5(section), sections, file) context from c""",
)
def context_fallback(spark, d):
    """Of each question the first of: a hit that scores, the section it was asked in, the five best sections, the open file."""
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    # Each search is written when it is done, so that what one has shuffled doesn't lie beside the other's.
    hits = materialised(text_hits(spark, d, 1).where("score >= 150").select("query_id", F.col("doc_id").cast("string").alias("context")))
    section = docs.where("text is not null and lang = 'en'").select(F.col("doc_id").alias("query_id"), F.md5("text").alias("context")).join(R.sized(asked), "query_id")
    found = materialised(X.search(index_of(spark, d), prefixes(spark, d), 5, prefix=True)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "doc_id"))).alias("s"))
    found = found.select("query_id", F.array_join(F.transform("s.doc_id", lambda x: x.cast("string")), ",").alias("context"))
    file = asked.where("query_id % 2 = 0").join(F.broadcast(docs.agg(F.min("source").alias("context"))), F.lit(True))
    return L.fallback(asked, [("hybrid", hits), ("section", section), ("section_search", found), ("file", file)])


@query(
    "tier_two_topk",
    """with q as (select vec_id query_id, embedding::double[] qe from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id id, round(list_dot_product(qe, embedding::double[]) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) + 0.0 score from q, embeddings where vec_id % 2 = 0)
select query_id, id, score, rnk::int rnk from (select *, row_number() over (partition by query_id order by score desc, id) rnk from s) where rnk <= 10""",
)
def tier_two_topk(spark, d):
    """A search in the second tier, whose vectors are longer and cover half of the chunks so far; those of the first don't compete."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    wide = e.select("id", F.concat("vector", "vector").alias("vector"))
    pool = e.union(wide.where("id % 2 = 0"))
    return N.nearest(wide.where("id % 100 = 0").withColumnRenamed("id", "query_id"), pool, 10)


@query("json_objects", "select event_id, json_extract_string(props, '$.k')::int k from events")
def json_objects(spark, d):
    """The object between the first brace and the last of a model's talk."""
    said = T.json_object(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" Anything else?")))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(said), "$.k", "int").alias("k"))


@query(
    "pending_jobs",
    """with j as (select user_id job, 'src' || (user_id % 20) book, arg_max(event_type, (ts, event_id)) status from events group by user_id),
c as (select source book, count(*) n_pending, min(doc_id) first_id from documents where doc_id % 3 <> 0 group by source)
select job, book, n_pending, first_id from j join c using (book) where status <> 'purchase'""",
)
def pending_jobs(spark, d):
    """What is left to do for each job that was running or paused when the work stopped."""
    log = table(spark, d, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "running").otherwise("paused").alias("status"))
    jobs = A.job_state(log).select("job", F.concat(F.lit("src"), (F.col("job") % 20).cast("string")).alias("book"), "status")
    status = F.when(F.col("doc_id") % 3 == 0, "done").when(F.col("doc_id") % 3 == 1, "failed")
    return L.pending(jobs, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book"), status.alias("status")))


@query("heading_plan", r"""with l as (select doc_id, unnest(string_split(text, E'\n')) s, unnest(range(len(string_split(text, E'\n')))) i from documents) select doc_id, count(*) headings, sum(length(trim(s)))::bigint label_chars from l where i % 2 = 0 and regexp_matches(s, '^[\p{L}\p{N}]') and not regexp_matches(s, '#\s*$') group by doc_id""")
def heading_plan(spark, d):
    """Headings by lines alone, as a client shows them before the text is parsed."""
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when((i % 2 == 0) & s.rlike(r"^[\p{L}\p{N}]") & ~s.rlike(r"#\s*$"), F.concat(F.lit("## "), s)).otherwise(F.lit("x")))
    plan = table(spark, d, "documents").select("doc_id", F.inline(T.heading_plan(F.array_join(lines, "\n"))))
    return plan.groupBy("doc_id").agg(F.count("*").alias("headings"), F.sum(F.length("label")).alias("label_chars"))
