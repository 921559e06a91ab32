"""Queries on ingestion: names, chapters, chunks, sections, stale sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import library as L
from ..sources import documents as D
from .base import query, table

_TITLE = "trim(regexp_replace(left(string_split(text, E'\\n')[1], 30), '\\r$', ''))"


@query("query_keys", r"select conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))), ' ') key from conversations where role = 'user'")
def query_keys(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_key(F.col("text")).alias("key"))


_LABEL = "case when p_size <= 10 then split_part(p_brand, '#', 1) else p_brand end"  # a family beside its members: numbers that come by nature


@query(
    "slug_paths",
    f"""with recursive b as (select p_partkey, p_type book, '§' || replace({_LABEL}, '#', '-') base, row_number() over (partition by p_type order by p_partkey) n from part),
r as (select distinct p_type book, 0::bigint n, null::bigint p_partkey, null::varchar path, []::varchar[] used from part
union all select book, n, p_partkey, path, list_append(used, path) from (select b.book, b.n, b.p_partkey, used,
  case when not list_contains(used, base) then base else base || '-' || list_filter(range(2, b.n + 2), lambda k: not list_contains(used, base || '-' || k))[1] end path from r join b on b.book = r.book and b.n = r.n + 1))
select p_partkey, path from r where n > 0""",
)
def slug_paths(spark, d):
    """Sections of a book in order: a path that is used already gets the first free number, whoever holds the others."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", T.slug(F.expr(_LABEL)).alias("base"))
    return L.probed(rows, "p_type", "base", "p_partkey").select("p_partkey", "path")


@query(
    "chapter_numbers",
    r"""with t as (select doc_id, case doc_id % 4 when 0 then 'Chapter ' || doc_id || ': x' when 1 then 'ch.' || (doc_id % 100) || ' y' when 2 then '제 ' || doc_id || ' 장' else 'no number ' || doc_id end title from documents),
c as (select doc_id, coalesce(try_cast(nullif(regexp_extract(lower(title), '^chapter\s+([0-9]{1,9})', 1), '') as int), try_cast(nullif(regexp_extract(lower(title), '^ch\.?\s*([0-9]{1,9})', 1), '') as int), try_cast(nullif(regexp_extract(title, '^제\s*([0-9]{1,9})', 1), '') as int)) n from t)
select doc_id, n, 'Ch' || case when n < 100 then lpad(n::varchar, 2, '0') else n::varchar end slug from c""",
)
def chapter_numbers(spark, d):
    i = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Chapter "), i, F.lit(": x"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("ch."), (F.col("doc_id") % 100).cast("string"), F.lit(" y"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("제 "), i, F.lit(" 장"))).otherwise(F.concat(F.lit("no number "), i))
    n = T.chapter_number(title)
    return table(spark, d, "documents").select("doc_id", n.alias("n"), T.chapter_slug(n).alias("slug"))


@query(
    "stale_sources",
    "select doc_id, case when doc_id % 11 = 0 then 'missing' when doc_id % 7 = 0 then 'changed' end as status from documents where doc_id % 11 = 0 or doc_id % 7 = 0",
)
def stale_sources(spark, d):
    """Documents stand for files: each eleventh is gone, each seventh was registered with another hash."""
    docs = table(spark, d, "documents").where("text is not null")
    books = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("file_hash"))
    now = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("now_hash"))
    return D.stale(books, now, "doc_id")


@query("chunk_preview", r"select doc_id, length(text) char_len, (length(text) * 30 + 99) // 100 token_count, contains(text, '```') has_code, left(text, 120) || case when length(text) > 120 then '…' else '' end head from documents")
def chunk_preview(spark, d):
    text = F.col("text")
    head = F.concat(F.substring(text, 1, 120), F.when(F.length(text) > 120, F.lit("…")).otherwise(F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.length(text).alias("char_len"), T.token_estimate(text).alias("token_count"), F.contains(text, F.lit("```")).alias("has_code"), head.alias("head"))


@query("valid_names", r"""select doc_id, not regexp_matches(n, '[/\\:*?"<>|\x00-\x1f]') and not regexp_matches(n, '^[ .]|[ .]$') and strlen(n) between 1 and 200 and not regexp_matches(lower(n), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$') ok from (select doc_id, left(text, 24) n from documents)""")
def valid_names(spark, d):
    return table(spark, d, "documents").select("doc_id", T.valid_name(F.substring("text", 1, 24)).alias("ok"))


@query("placeholder_titles", r"select conv_id, turn, case when length(t) > 40 then left(t, 40) || '…' else t end title from (select conv_id, turn, trim(replace(text, E'\n', ' ')) t from conversations where turn = 0)")
def placeholder_titles(spark, d):
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", "turn", T.title_of(F.col("text")).alias("title"))


_SEG = "substr(text, start + 2400 + 1, 1600)"
_ENDS = f"""case when n - start <= 4000 then n
 when contains({_SEG}, E'\\n\\n') then start + 2400 + length({_SEG}) - strpos(reverse({_SEG}), E'\\n\\n') + 1
 when contains({_SEG}, E'\\n') then start + 2400 + length({_SEG}) - strpos(reverse({_SEG}), E'\\n') + 1
 when regexp_matches({_SEG}, '(?s)[.!?。！？]\\s') then start + 2400 + length(regexp_extract({_SEG}, '(?s)^.*[.!?。！？]\\s+'))
 when contains({_SEG}, ' ') then start + 2400 + length({_SEG}) - strpos(reverse({_SEG}), ' ') + 1 else start + 4000 end"""
_TRIMMED = """case when cut >= n or regexp_matches(substr(text, start + 1, cut - start), '[.!?。！？]\\s*$') then cut
 when length(regexp_extract(substr(text, start + 1, cut - start), '(?s)^(.*[.!?。！？])\\s', 1)) >= 100 then start + length(regexp_extract(substr(text, start + 1, cut - start), '(?s)^(.*[.!?。！？])\\s', 1)) else cut end"""


_WINDOWS = f"""t as (select doc_id, text, length(text) n from documents where length(text) > 0),
w as (select doc_id, text, n, 0 k, 0::bigint start, {_TRIMMED.replace("cut", f"({_ENDS.replace('start', '0')})").replace("start", "0")} stop from t
union all select doc_id, text, n, k + 1, start, {_TRIMMED} stop from (select *, {_ENDS} cut from (select doc_id, text, n, k, greatest(start + 1, stop - 480) start from w where stop < n))),
wi as (select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int ord, start span_start, substr(text, start + 1, stop - start) as text from w where regexp_matches(substr(text, start + 1, stop - start), '\\S'))"""


@query("chunk_windows", f"with recursive {_WINDOWS} select doc_id, ord, span_start, text, (length(text) * 30 + 99) // 100 token_count from wi")
def chunk_windows(spark, d):
    return chunking.windows(table(spark, d, "documents").select("doc_id", "text"))


@query("sentence_chunks")
def sentence_chunks(spark, d):
    return chunking.sentence_chunks(table(spark, d, "documents").select("doc_id", "text"))


@query("html_heading_counts", r"select page_id, len(regexp_extract_all(lower(html), '<h[1-6][\s>]')) headings from pages")
def html_heading_counts(spark, d):
    out = D.html_sections(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    counts = out.groupBy("doc_id").agg(F.count("*").cast("int").alias("headings"))
    return table(spark, d, "pages").select("page_id").join(counts, F.col("page_id") == F.col("doc_id"), "left").select("page_id", F.coalesce("headings", F.lit(0)).alias("headings"))


_LABELS = "regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)"
_PLAIN = "trim({x})"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"


@query(
    "html_headings",
    f"""with h as (select page_id, unnest({_LABELS}) l, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>[^<]*</h[1-6]>', 1))::int as level, unnest(range(len({_LABELS})))::int ord from pages)
select page_id, ord, level, {_PLAIN.format(x="l")} as label, case when level = min(level) over (partition by page_id) then 1 else 0 end chapter from h""",
)
def html_headings(spark, d):
    """Level, label and place of every heading, and whether it is a chapter."""
    out = D.html_sections(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    chapter = F.when(F.col("parent_path").isNull() & F.col("path").rlike("^Ch[0-9]"), 1).otherwise(0)
    return out.select(F.col("doc_id").alias("page_id"), "ord", "level", "label", chapter.alias("chapter"))


@query("html_sections")
def html_sections(spark, d):
    return D.html_sections(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query("html_sanitised")
def html_sanitised(spark, d):
    return table(spark, d, "pages").select("page_id", D.sanitised(F.col("html")).alias("html"))


@query(
    "markdown_sections",
    r"""with l as (select doc_id, unnest(string_split(text, E'\n')) s, unnest(range(len(string_split(text, E'\n')))) i from documents)
select doc_id, count(*) sections, sum(length(s))::bigint label_chars from l where i % 2 = 0 and regexp_matches(s, '^[\p{L}\p{N}]') and not regexp_matches(s, '#\s*$') group by doc_id""",
)
def markdown_sections(spark, d):
    """Each second line of a document made a heading, where it begins with a letter or digit."""
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when((i % 2 == 0) & s.rlike(r"^[\p{L}\p{N}]") & ~s.rlike(r"#\s*$"), F.concat(F.lit("# "), s)).otherwise(F.concat(F.lit("  x "), F.regexp_replace(s, r"[^\p{L} ]", ""))))
    made = table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("text"))
    out = D.markdown_sections(made)
    return out.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("label")).alias("label_chars"))
