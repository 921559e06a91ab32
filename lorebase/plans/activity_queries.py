"""Queries on signals, conversations, gates, memory, caches and queues; events stand for the logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity as A
from .base import query, table


def _signals(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("study"), F.col("event_type").alias("type"), F.col("event_id").alias("id"), "ts", (F.col("event_id") % 10 == 0).alias("dismissed"))


@query(
    "repeat_search_signals",
    """with s as (select user_id % 20 study, event_type key, event_id id, ts, count(*) over (partition by user_id % 20, event_type order by epoch(date_trunc('second', ts))::bigint range between 1800 preceding and current row) cnt from events)
select study, key, id, cnt, least(1.0, cnt / 10) severity from s where cnt >= 3""",
)
def repeat_search_signals(spark, d):
    return A.repeat_signals(_signals(spark, d).withColumnRenamed("type", "key"))


@query(
    "multi_signal_alerts",
    """with s as (select user_id % 20 study, event_type t, event_id id, ts, epoch(date_trunc('second', ts))::bigint sec from events where event_id % 10 <> 0),
a as (select x.study, x.id, x.ts, list_sort(list_distinct(list(y.t))) ty from s x join s y on y.study = x.study and y.sec between x.sec - 300 and x.sec group by all)
select study, id, ts, array_to_string(ty, '+') combo, len(ty)::int n_types from a where len(ty) >= 2""",
)
def multi_signal_alerts(spark, d):
    return A.alerts(_signals(spark, d))


@query(
    "cooldown_pass",
    """with recursive e as (select user_id as key, event_id id, ts, row_number() over (partition by user_id order by ts, event_id) n from events),
r as (select key, id, ts, n, ts as last, true as pass from e where n = 1
union all select e.key, e.id, e.ts, e.n, case when e.ts >= r.last + interval 21600 second then e.ts else r.last end, e.ts >= r.last + interval 21600 second from r join e on e.key = r.key and e.n = r.n + 1)
select key, id, ts from r where pass""",
)
def cooldown_pass(spark, d):
    return A.cooldown(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts"), 21600)


@query("short_dwell", "select event_id, user_id, 0.5::double severity from events where value * 100 < 500 and length(props) >= 8")
def short_dwell(spark, d):
    e = table(spark, d, "events").where((F.col("value") * 100 < 500) & (F.length("props") >= 8))
    return e.select("event_id", "user_id", F.lit(0.5).alias("severity"))


@query(
    "recall_outcomes",
    """select 'signal' kind, user_id study, event_id id, null::double confidence from events where event_type <> 'click'
union all select 'fact', user_id, event_id, 0.7 from events where event_type <> 'click' union all select 'attempt', user_id, event_id, null from events""",
)
def recall_outcomes(spark, d):
    outcome = F.when(F.col("event_type") == "click", "correct").otherwise(F.col("event_type"))
    routes = A.outcome_routes(table(spark, d, "events").select(F.col("user_id").alias("study"), F.col("event_id").alias("id"), "ts", outcome.alias("outcome"), F.col("props").alias("text")))
    none = F.lit(None).cast("double").alias("confidence")
    out = routes["signals"].select(F.lit("signal").alias("kind"), "study", "id", none)
    out = out.union(routes["facts"].select(F.lit("fact"), "study", "id", "confidence"))
    return out.union(routes["attempts"].select(F.lit("attempt"), "study", "id", none))


@query("metacog_gaps", "select event_id, round(least(1.0, greatest(0.0, 0.5 + (g - 0.3) / 0.7)), 6) severity from (select event_id, abs((event_id % 100) / 100 - (user_id % 100) / 100) g from events) where g >= 0.3")
def metacog_gaps(spark, d):
    s = T.progress_gap_severity((F.col("event_id") % 100) / 100, (F.col("user_id") % 100) / 100)
    return table(spark, d, "events").select("event_id", F.round(s, 6).alias("severity")).where("severity is not null")


@query(
    "response_latency",
    """with p as (select conv_id, turn, role, lead(role) over w r2, lead(turn) over w t2 from conversations window w as (partition by conv_id order by turn))
select conv_id, count(*) pairs, avg(t2 - turn) mean_delta from p where role = 'user' and r2 = 'assistant' group by conv_id""",
)
def response_latency(spark, d):
    return A.latency(table(spark, d, "conversations")).groupBy("conv_id").agg(F.count("*").alias("pairs"), F.avg("delta").alias("mean_delta"))


@query(
    "followup_reuse",
    """with c as (select *, length(trim(text)) >= 2 and ((length(trim(text)) <= 6 and regexp_matches(trim(text), '왜|어떻게|뭐|어디')) or regexp_matches(trim(text), '그러면|그럼|그건 왜|왜 그래|왜 그런|다시 설명|더 자세|예시|구체적|근거|출처|이전에|방금|그 부분|그것|그게 무슨|어떻게 그') or contains(text, '?')) f, coalesce(last_value(case when role = 'assistant' then length(text) % 3 > 0 end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), false) had from conversations)
select conv_id, count(*) users, count(*) filter (f) followups, count(*) filter (f and had) reusable from c where role = 'user' group by conv_id""",
)
def followup_reuse(spark, d):
    return A.followup_reuse(table(spark, d, "conversations"), F.length("text") % 3 > 0, T.is_followup(F.col("text")) | ((F.length(F.btrim("text")) >= 2) & F.contains("text", F.lit("?"))))


@query("recent_turns", "select conv_id, turn, role, back::int back from (select *, row_number() over (partition by conv_id order by turn desc) back from conversations) where back <= 4")
def recent_turns(spark, d):
    return A.recent(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role", "back")


@query("session_counts", "select s.conv_id, coalesce(n, 0) users from (select distinct conv_id from conversations) s left join (select conv_id, count(*) n from conversations where role = 'user' group by all) using (conv_id)")
def session_counts(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"))


@query("session_backfill", "select user_id study, min(ts) created_at, max(ts) updated_at, count(*) messages from events group by user_id")
def session_backfill(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("study")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("messages"))


@query("message_page", "select conv_id, turn, role from (select * from conversations where conv_id < 50 order by conv_id desc, turn desc limit 20) order by conv_id, turn")
def message_page(spark, d):
    last = table(spark, d, "conversations").where("conv_id < 50").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20)
    return last.select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query(
    "gate_report",
    """with f as (select round(count(*) filter (event_type = 'click') / count(*), 6) active_ratio from events where ts >= timestamp '2024-01-24'),
c as (select round(count(*) filter (quality = 1) / count(*), 6) card_ratio from labels),
a as (select count(*) filter (event_type = 'view') dismissed, round(count(*) filter (event_type in ('click', 'purchase')) / count(*), 6) attempted_ratio from events),
r as (select round(avg(value), 6) rating_mean from (select value from events order by ts desc, event_id desc limit 10)),
m as (select round(avg((event_id % 10) / 10), 6) citation_mean from (select event_id from events order by event_id desc limit 50) where event_id % 7 <> 0)
select * from f, c, a, r, m""",
)
def gate_report(spark, d):
    e = table(spark, d, "events")
    week = e.where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).select(F.when(F.col("event_type") == "click", "active").otherwise("archived").alias("status"))
    cards = table(spark, d, "labels").select(F.lit("deterministic_cloze").alias("method"), F.col("quality").alias("citation"))
    outcome = F.when(F.col("event_type") == "view", "dismissed").when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "purchase", "incorrect").otherwise("timeout")
    return A.gates(week, cards, e.select(outcome.alias("outcome")), e.select("ts", F.col("event_id").alias("id"), F.col("value").alias("rating")), _contexts(spark, d))


_CTX = """case when event_id % 7 = 0 then 'broken {' else '{"kind":"hybrid","citation_scores":[{"source_idx":1,"score":' || (event_id % 10) / 10 || ',"verdict":"' || case when event_id % 10 >= 5 then 'pass' when event_id % 10 >= 4 then 'low' else 'no_match' end || '"}]}' end"""


@query(
    "citation_accuracy",
    f"""with m as (select event_id id, {_CTX} c from events order by event_id desc limit 200), v as (select id, (c::json->'citation_scores'->0->>'score')::double s, c::json->'citation_scores'->0->>'verdict' v from m where json_valid(c))
select count(distinct id) messages, count(*) markers, count(*) filter (v = 'pass') passes, count(*) filter (v = 'low') lows, count(*) filter (v = 'no_match') no_matches, round(count(*) filter (v = 'pass') / count(*), 6) pass_ratio, round(avg(s), 6) avg_score from v""",
)
def citation_accuracy(spark, d):
    return A.citation_accuracy(_contexts(spark, d))


def _contexts(spark, d):
    """Messages with a JSON context, each seventh one malformed."""
    k = F.col("event_id") % 10
    good = F.format_string('{"kind":"hybrid","citation_scores":[{"source_idx":1,"score":%s,"verdict":"%s"}]}', (k / 10).cast("string"), F.when(k >= 5, "pass").when(k >= 4, "low").otherwise("no_match"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, "broken {").otherwise(good).alias("context_json"))


@query("ab_votes", "select count(*) filter (event_id % 3 = 0) baseline, count(*) filter (event_id % 3 = 1) v041, count(*) filter (event_id % 3 = 2) tie, count(*) total from events")
def ab_votes(spark, d):
    chose = F.element_at(F.array(F.lit("baseline"), F.lit("v041"), F.lit("tie")), (F.col("event_id") % 3 + 1).cast("int"))
    n = table(spark, d, "events").select(chose.alias("chose")).groupBy().pivot("chose", ["baseline", "v041", "tie"]).count()
    return n.select("*", (F.col("baseline") + F.col("v041") + F.col("tie")).alias("total"))


@query("last_n_mean", "select user_id, round(avg(value), 6) mean from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 10 group by user_id")
def last_n_mean(spark, d):
    last = A.latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 10)
    return last.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("prefix_cache_ratio", "select round(sum(greatest(c, 0)) / (sum(greatest(c, 0)) + sum(greatest(f, 0))), 6) ratio, count(*) rows_used from (select event_id % 13 - 3 c, user_id % 7 - 2 f from events) where c > 0 or f > 0")
def prefix_cache_ratio(spark, d):
    return A.prefix_cache_ratio(table(spark, d, "events").select((F.col("event_id") % 13 - 3).alias("cached"), (F.col("user_id") % 7 - 2).alias("fresh")))


@query("timing_statistics", "select event_type, round(avg(value), 6) mean, round(median(value), 6) median, min(value) least, max(value) most, arg_min(value, event_id) cold from events group by event_type")
def timing_statistics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.min_by("value", "event_id").alias("cold"))


@query("trace_totals", "select user_id trace, round(sum(value), 4) total_ms, count(*) spans, max(json_extract_string(props, '$.k')::int) top_k from events group by user_id")
def trace_totals(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("trace")).agg(F.round(F.sum("value"), 4).alias("total_ms"), F.count("*").alias("spans"), F.max(k).alias("top_k"))


@query(
    "memory_injection",
    """with f as (select conv_id % 10 study, turn, conv_id * 100 + turn id, case when role = 'user' then 'preference' else 'goal' end kind, regexp_replace(text, E'\\n', ' ', 'g') content from conversations where (conv_id + turn) % 3 > 0),
g as (select study, kind, string_agg('- ' || content, E'\\n' order by turn, id) t from f group by all),
x as (select study, kind, case when length(t) <= lim then t else regexp_replace(left(t, lim), E'\\n[^\\n]*$', '') || E'\\n…' end t from (select *, case when kind = 'preference' then 2000 else 4000 end lim from g))
select study, coalesce(max(t) filter (kind = 'preference'), '') l1, coalesce(max(t) filter (kind = 'goal'), '') l2 from x group by study""",
)
def memory_injection(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "preference").otherwise("goal")
    status = F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, "active").otherwise("archived")
    content = F.regexp_replace("text", "\n", " ")
    return A.memory_levels(c.select((F.col("conv_id") % 10).alias("study"), F.col("turn").alias("created"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), kind.alias("kind"), status.alias("status"), F.lit(0.9).alias("confidence"), content.alias("content")))


@query(
    "conflict_pairs",
    r"""with t as (select conv_id % 10 study, conv_id * 100 + turn id, role, regexp_extract_all(text, '[\p{L}\p{N}]{2,}') k from conversations),
p as (select study, id pref_id, unnest(k) token, unnest(range(len(k))) pos from t where role = 'user'),
c as (select distinct study, id corr_id, unnest(k) token from t where role = 'system'),
s as (select * from p where token not in ('active', 'deprecated', 'resolved', 'achieved', 'since', '지적', '회'))
select study, pref_id, corr_id, arg_min(s.token, pos) token from s join c using (study, token) group by all""",
)
def conflict_pairs(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("study"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text")
    return A.conflicts(c.where("role = 'user'"), c.where("role = 'system'"))


@query("cache_lru", "select event_id, case when event_id % 4 = 0 then null else event_id * 7 % 1000 end last_hit from events order by coalesce(case when event_id % 4 = 0 then null else event_id * 7 % 1000 end, 0) desc, event_id limit 1000")
def cache_lru(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 7 % 1000).alias("last_hit"))
    return A.evict_lru(rows, "event_id", 1000)


@query(
    "cache_ttl",
    """with c as (select user_id, max(ts) created from events where event_type = 'view' group by all)
select k.user_id as key, coalesce(created >= timestamp '2024-01-31' - interval 12 hour, false) hit from (select distinct user_id from events) k left join c using (user_id)""",
)
def cache_ttl(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "key")
    cache = e.where("event_type = 'view'").groupBy("key").agg(F.max("ts").alias("created"))
    return A.fresh(cache, e.select("key").distinct(), F.lit("2024-01-31").cast("timestamp_ntz"), "12 hours").select("key", "hit")


@query("upsert_latest", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k = 1")
def upsert_latest(spark, d):
    return A.latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query(
    "retry_schedule",
    """select study, job_type, payload, attempts, ts + case attempts when 1 then interval 1 minute when 2 then interval 2 minute when 3 then interval 4 minute when 4 then interval 8 minute end next_retry
from (select user_id study, event_type job_type, event_id % 20 payload, count(*) attempts, max(ts) ts from events group by all)""",
)
def retry_schedule(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("study"), F.col("event_type").alias("job_type"), (F.col("event_id") % 20).alias("payload"), "ts")
    return A.retry_schedule(e)


@query("response_keys", "select conv_id, turn, sha256(concat_ws(chr(31), 'b' || (conv_id % 5), text, array_to_string(list_sort([turn, conv_id, 7]), ','), 'm')) key from conversations where role = 'user'")
def response_keys(spark, d):
    ids = F.array("turn", "conv_id", F.lit(7).cast("long"))
    key = T.response_key(F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")), F.col("text"), ids, F.lit("m"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", key.alias("key"))


@query("embedding_keys", "select doc_id, sha256(coalesce(text, '') || ':e5') key from documents where text is not null")
def embedding_keys(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.embedding_key(F.col("text"), F.lit("e5")).alias("key"))


@query("job_state", "select user_id job, arg_max(event_type, (ts, event_id)) status, min(ts) filter (event_type = 'view') started, max(ts) updated from events group by user_id")
def job_state(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("id"))
    out = A.job_state(log.withColumn("status", F.when(F.col("kind") == "view", "running").otherwise(F.col("kind"))))
    return out.withColumn("status", F.when(F.col("status") == "running", "view").otherwise(F.col("status")))


@query("embed_failures", "select doc_id, doc_id % 4 + 1 attempts, case when doc_id % 4 + 1 >= 3 then 'failed' else 'pending' end as status from documents")
def embed_failures(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("attempts"), F.lit("pending").alias("status"))
    return A.embed_failures(rows)


@query("cascade_delete", "select 'messages' t, count(*) n from conversations where conv_id % 5 <> 0 union all select 'vectors', count(*) from embeddings where vec_id not in (select doc_id from documents where doc_id % 5 = 0 union select conv_id from conversations where conv_id % 5 = 0)")
def cascade_delete(spark, d):
    gone = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id").union(table(spark, d, "conversations").where("conv_id % 5 = 0").select("conv_id")).distinct()
    left = A.cascade(gone, {"messages": (table(spark, d, "conversations"), "conv_id"), "vectors": (table(spark, d, "embeddings"), "vec_id")}, "doc_id")
    parts = [df.agg(F.lit(name).alias("t"), F.count("*").alias("n")) for name, df in left.items()]
    return parts[0].union(parts[1])


@query(
    "markdown_export",
    """with l as (select string_agg('- ' || event_id || ': ' || event_type, E'\\n' order by event_id desc) rows from (select * from events order by event_id desc limit 200)),
s as (select 'total ' || count(*) || ', view ' || count(*) filter (event_type = 'view') || ', click ' || count(*) filter (event_type = 'click') stats from events)
select '## Votes' || E'\\n\\n' || stats || E'\\n\\n## Last' || E'\\n\\n' || rows report from l, s""",
)
def markdown_export(spark, d):
    """The votes' statistics, then the last 200 rows, as one text."""
    e = table(spark, d, "events")
    last = e.orderBy(F.desc("event_id")).limit(200)
    line = F.concat(F.lit("- "), F.col("event_id").cast("string"), F.lit(": "), F.col("event_type"))
    rows = last.agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l"))), asc=False).alias("r"), F.lit(1).alias("one"))
    count = lambda c: c.cast("string")
    stats = e.agg(F.concat(F.lit("total "), count(F.count("*")), F.lit(", view "), count(F.count_if(F.col("event_type") == "view")), F.lit(", click "), count(F.count_if(F.col("event_type") == "click"))).alias("s"), F.lit(1).alias("one"))
    return rows.join(stats, "one").select(F.concat(F.lit("## Votes\n\n"), "s", F.lit("\n\n## Last\n\n"), F.array_join("r.l", "\n")).alias("report"))


# What an event's user says of it, and how well their answers were cited.
_SAYS = "case event_type when 'view' then 'I Know ' || props when 'click' then props || ' 쉽다' when 'purchase' then 'so EASY' else props end"


@query("self_reports", f"select event_id, round(least(1.0, greatest(0.0, 0.5 + 0.4 - coalesce(value / 100, 0))), 6) severity from events where regexp_matches(lower({_SAYS}), 'i know|i got it|easy|쉽다|쉬워|이해했다') and coalesce(value / 100, 0) <= 0.4")
def self_reports(spark, d):
    s = T.self_report_severity(F.expr(_SAYS), F.col("value") / 100)
    return table(spark, d, "events").select("event_id", F.round(s, 6).alias("severity")).where("severity is not null")


@query("reading_progress", "with o as (select source, doc_id // 100 section_no, row_number() over (partition by source order by doc_id) - 1 ord from documents) select source, min(ord) filter (section_no = 1)::double / nullif(max(ord), 0) progress from o group by source")
def reading_progress(spark, d):
    """Where the section that is open begins, as a share of the book."""
    docs = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 100).alias("section_no"), "doc_id")
    rows = docs.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    at = F.min(F.when(F.col("section_no") == 1, F.col("ord"))).cast("double") / F.nullif(F.max("ord"), F.lit(0))
    return rows.groupBy("source").agg(F.when(at.isNotNull(), T.clamp(at)).alias("progress"))
