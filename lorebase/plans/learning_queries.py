"""Queries on cards, spaced repetition, recall and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import learning as L
from .base import query, table

_STOPS = ",".join(f"'{w}'" for w in T.KEYWORD_STOPS)
_KW = rf"""tk as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) term from documents),
kc as (select doc_id, term, count(*) cnt from tk where length(term) >= 2 and term not in ({_STOPS}) group by all),
kw as (select * from (select *, row_number() over (partition by doc_id order by cnt desc, term) rnk from kc) where rnk <= 8)"""


@query("keyword_topk", f"with {_KW} select doc_id, term, cnt, rnk::int rnk from kw")
def keyword_topk(spark, d):
    return L.keywords(table(spark, d, "documents"))


@query(
    "recall_eval",
    rf"""with {_KW}, ex as (select doc_id, list_sort(list(term)) e from kw group by doc_id),
an as (select doc_id, regexp_replace(lower(left(text, 200)), '[^\p{{L}}\p{{N}}\s]', '', 'g') a from documents),
j as (select doc_id, e, list_filter(e, lambda k: contains(a, k)) p from ex join an using (doc_id))
select doc_id, len(e)::int n_expected, len(p)::int n_present, array_to_string(list_filter(e, lambda k: not list_contains(p, k)), ',') missing, coalesce(len(p) / len(e) >= 0.6, false) passed from j""",
)
def recall_eval(spark, d):
    docs = table(spark, d, "documents")
    return L.recall(L.keywords(docs), docs.select("doc_id", F.substring("text", 1, 200).alias("answer")))


@query(
    "cloze_cards",
    r"""with t as (select doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]{2,}') k from documents),
p as (select doc_id, text, list_slice(list_filter(range(len(k)), lambda i: i % greatest(1, len(k) // 3) = 0), 1, 3) ix, k from t),
r as (select doc_id, text, unnest(range(len(ix))) n, unnest(list_transform(ix, lambda i: k[i + 1])) back from p)
select doc_id, n::int n, left(text, strpos(text, back) - 1) || '[___]' || substr(text, strpos(text, back) + length(back)) front, back from r""",
)
def cloze_cards(spark, d):
    return L.cloze(table(spark, d, "documents"))


@query(
    "card_sources",
    r"""with d as (select doc_id, text, lead(text) over (partition by source order by doc_id) nxt, regexp_extract_all(text, '[\p{L}\p{N}]{2,}') k from documents),
p as (select doc_id, nxt, k, list_slice(list_filter(range(len(k)), lambda i: i % greatest(1, len(k) // 3) = 0), 1, 3) ix from d where nxt is not null),
r as (select doc_id, nxt, unnest(range(len(ix))) n, unnest(list_transform(ix, lambda i: k[i + 1])) back from p),
s as (select *, case when length(back) < 6 then contains(nxt, back) else len(list_filter(range(1, length(back) - 4), lambda i: contains(nxt, substr(back, i, 6)))) > 0 end kept from r)
select doc_id, n::int n, back, case when kept then 0.6 else 0.0 end::double score, kept from s""",
)
def card_sources(spark, d):
    """Cards of each chunk held against the book's next one: an answer that isn't there drops its card."""
    docs = table(spark, d, "documents")
    following = docs.select("doc_id", "source").withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))).where("next_id is not null")
    sources = following.select("doc_id", "next_id").join(docs.select(F.col("doc_id").alias("next_id"), "text"), "next_id")
    return L.sourced(L.cloze(docs).select("doc_id", "n", "back"), sources)


_CH = "ch as (select source book, 's' || (doc_id // 100) section, doc_id, text from documents)"


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("book"), F.concat(F.lit("s"), F.floor(F.col("doc_id") / 100).cast("string")).alias("section"), "doc_id", "text")


@query(
    "match_cards",
    rf"""with {_CH}, pr as (select book, section, doc_id, left(regexp_replace(string_split(text, E'\n')[1], '\r$', ''), 100) line, lead(doc_id) over (partition by book, section order by doc_id) next_id from ch),
f as (select book, section, doc_id, md5(doc_id || ':7') h from ch),
f1 as (select *, row_number() over (partition by book, section order by h, doc_id) k from f),
f2 as (select *, row_number() over (partition by book order by h, doc_id) k2 from f1 where k <= 3),
pl as (select book, list({{'h': h, 'd': doc_id, 's': section}} order by h, doc_id) pool from f2 where k2 <= 6 group by book),
j as (select pr.*, '청크 #' || next_id || ' (' || section || ')' right_one, list_transform(list_slice(list_filter(pool, lambda x: x.s <> section), 1, 3), lambda x: '청크 #' || x.d || ' (' || x.s || ')') others from pr join pl using (book) where next_id is not null and trim(line) <> ''),
o as (select *, list_concat([right_one], others) ls from j)
select doc_id, E'다음 첫 줄은 어느 단락에 속합니까?\n\n"' || line || '"' front, '정답: ' || right_one || E'\n\n' || array_to_string(list_transform(range(len(ls)), lambda i: chr((65 + i)::int) || '. ' || ls[i + 1]), E'\n') back from o""",
)
def match_cards(spark, d):
    return L.match(_chunks(spark, d))


@query(
    "order_cards",
    rf"""with {_CH}, f as (select book, section, doc_id, left(regexp_replace(string_split(text, E'\n')[1], '\r$', ''), 80) line, row_number() over (partition by book, section order by doc_id) k from ch),
s as (select book, section, min(doc_id) doc_id, list(line order by doc_id) c from f where k <= 5 group by all having count(*) >= 3),
x as (select *, list_concat(list_concat([c[len(c)]], list_slice(c, 2, len(c) - 1)), [c[1]]) w from s)
select book, section, doc_id, E'다음 단락들을 원래 순서대로 정렬하시오.\n\n' || array_to_string(list_transform(range(len(w)), lambda i: chr((65 + i)::int) || '. ' || w[i + 1]), E'\n') front,
'정답 순서: ' || array_to_string(list_transform(range(len(w)), lambda i: chr((65 + case when i = 0 then len(w) - 1 when i = len(w) - 1 then 0 else i end)::int)), ' → ') || E'\n\n(각 알파벳이 위 선택지의 단락)' back from x""",
)
def order_cards(spark, d):
    return L.order(_chunks(spark, d))


def _reviews(spark, d):
    """Events as reviews: the user's card, the event's number its place, the value's tenths its quality."""
    return table(spark, d, "events").select(F.col("user_id").alias("card"), F.col("event_id").alias("seq"), (F.col("event_id") % 6).alias("q"))


@query(
    "sm2_replay",
    """with recursive e as (select user_id card, event_id % 6 q, row_number() over (partition by user_id order by event_id) n from events),
r as (select distinct user_id card, 0::bigint n, 2.5::double ef, 0::bigint itv, 0::bigint reps from events
union all select r.card, e.n, greatest(1.3, ef + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)),
 case when q < 3 then 1 when reps = 0 then 1 when reps = 1 then 6 else greatest(round(itv * greatest(1.3, ef + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))::bigint, itv + 1) end,
 case when q < 3 then 0 else reps + 1 end from r join e on e.card = r.card and e.n = r.n + 1)
select card, n::int n, round(ef, 6) ef, itv as "interval", reps from r where (card, n) in (select card, max(n) from r group by card)""",
)
def sm2_replay(spark, d):
    return L.replay(_reviews(spark, d))


@query("srs_due", "select user_id card, count(*) due from events where (ts + to_days((event_id % 30)::int))::date <= date '2024-01-20' and value is not null group by all")
def srs_due(spark, d):
    due = F.to_date(F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 30).cast("int")))
    return table(spark, d, "events").where(F.col("value").isNotNull() & (due <= F.lit("2024-01-20").cast("date"))).groupBy(F.col("user_id").alias("card")).agg(F.count("*").alias("due"))


@query(
    "weak_priority",
    """with l as (select event_id fact_id, event_id % (select count(*) from documents) doc_id, round(value, 6) similarity from events),
f as (select event_id fact_id from events where event_type = 'click' and event_id % 3 <> 0)
select doc_id, max(similarity) similarity from l join f using (fact_id) join documents using (doc_id) group by doc_id""",
)
def weak_priority(spark, d):
    e, docs = table(spark, d, "events"), table(spark, d, "documents")
    kind = F.when(F.col("event_type") == "click", "correction").otherwise("goal")
    facts = e.select(F.col("event_id").alias("fact_id"), kind.alias("kind"), F.when(F.col("event_id") % 3 != 0, "active").otherwise("archived").alias("status"))
    links = e.select(F.col("event_id").alias("fact_id"), (F.col("event_id") % docs.count()).alias("doc_id"), F.round("value", 6).alias("similarity"))
    return L.weak_areas(facts, links, docs)


def _answers(spark, d):
    """Each benchmark text with markers after its sentences; marker n's source is document item_id * 3 + n."""
    b = table(spark, d, "benchmark")
    text = F.regexp_replace("text", r"\. ", " [S1]. ")
    return b.select(F.col("item_id").alias("answer_id"), F.concat(text, F.lit(" and so on [S2]. See [S9] too [S1].")).alias("answer"))


@query(
    "citation_parse",
    r"""with a as (select item_id answer_id, replace(text, '. ', ' [S1]. ') || ' and so on [S2]. See [S9] too [S1].' answer from benchmark),
m as (select answer_id, unnest(regexp_extract_all(answer, '\[S([0-9]{1,9})\]', 1)) s, unnest(range(len(regexp_extract_all(answer, '\[S([0-9]{1,9})\]', 1)))) pos from a)
select answer_id, pos::int pos, s::bigint marker, s::bigint between 1 and 3 in_range from m""",
)
def citation_parse(spark, d):
    rows = _answers(spark, d).select("answer_id", F.posexplode(T.markers(F.col("answer"))).alias("pos", "marker"))
    return rows.withColumn("in_range", F.col("marker").between(1, 3))


@query(
    "citation_verdict",
    r"""with a as (select item_id answer_id, replace(text, '. ', ' [S1]. ') || ' and so on [S2]. See [S9] too [S1].' answer from benchmark),
src as (select b.item_id answer_id, n marker, case when n = 1 then b.text else d.text end as text from benchmark b, range(1, 4) r(n), documents d where d.doc_id = b.item_id * 3 + n),
m as (select distinct answer_id, answer, unnest(regexp_extract_all(answer, '\[S([0-9]{1,9})\]', 1))::bigint marker from a),
s as (select answer_id, marker, trim(unnest(regexp_extract_all(answer, '[^.!?。\n]+[.!?。]?'))) t from m),
h as (select answer_id, marker, array_to_string(list_sort(list_distinct(list(trim(regexp_replace(t, '\s*\[S[0-9]+\]', '', 'g'))))), ' ') said from s where contains(t, '[S' || marker || ']') group by all),
j as (select answer_id, marker, case when length(said) < 6 then 0.0 when len(list_filter(range(1, length(said) - 4), lambda i: contains(text, substr(said, i, 6)))) > 0 then 0.6 else 0.0 end score from h join src using (answer_id, marker))
select answer_id, marker, score::double score, case when score >= 0.5 then 'pass' when score >= 0.4 then 'low' else 'no_match' end verdict from j""",
)
def citation_verdict(spark, d):
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    wanted = b.select(F.col("item_id").alias("answer_id"), F.col("text").alias("own"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("marker"))
    wanted = wanted.withColumn("doc_id", F.col("answer_id") * 3 + F.col("marker"))
    src = wanted.join(docs.select("doc_id", "text"), "doc_id").select("answer_id", "marker", F.when(F.col("marker") == 1, F.col("own")).otherwise(F.col("text")).alias("text"))
    return L.verdicts(_answers(spark, d), src)
