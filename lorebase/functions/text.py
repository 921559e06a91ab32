"""Text functions as column expressions: tokens, estimates, normal forms, routing and marker parsing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
META = "\"*^():\\"

# Word lists that the results depend on.
CONCEPT_MARKERS = ("왜", "어떻게", "무엇", "뭐", "차이", "비교", "관계", "설명", "이유", "원리", "why", "how", "what", "explain", "difference", "compare", "relationship", "concept")
FOLLOWUP_HINTS = ("그러면", "그럼", "그건 왜", "왜 그래", "왜 그런", "다시 설명", "더 자세", "예시", "예시를", "구체적", "근거", "출처", "이전에", "방금", "방금 답변", "그 부분", "그것", "그게 무슨", "어떻게 그", "방금 말한")
SHORT_WH = ("왜", "어떻게", "뭐", "어디")
SELF_REPORTS = ("잘 안다", "잘 알아", "이미 안다", "이미 알아", "쉽다", "쉬워", "이건 쉬워", "다 알아", "이해했다", "i know", "i got it", "easy")
KEYWORD_STOPS = ("the", "and", "for", "with", "that", "this", "from", "into", "have", "has", "was", "were", "are", "is", "or", "but", "not", "you", "your", "they", "them", "이것", "그것", "저것", "그리고", "또는", "하지만", "그러나")
STATUS_WORDS = ("active", "deprecated", "resolved", "achieved", "since", "지적", "회")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas that name a column's expression would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and what is left of them without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, PLAIN = _folding()


def fold_diacritics(text: Column) -> Column:
    """Latin letters without their marks; indexes fold them on both sides."""
    return F.translate(text, MARKED, PLAIN)


def index_text(text: Column) -> Column:
    """What both full-text indexes tokenise."""
    return fold_diacritics(F.lower(text))


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text indexes: lower-cased runs of letters and digits, without diacritics."""
    return F.regexp_extract_all(index_text(text), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Thirty tokens for a hundred characters, rounded up."""
    return F.floor((F.length(text) * 30 + 99) / 100).cast("long")


def phrase_terms(query: Column) -> Column:
    """Terms of a chunk search: index syntax stripped, split at white space, blanks out."""
    plain = F.translate(query, META, " " * len(META))
    return F.filter(F.split(plain, r"\s+"), lambda x: x != "")


def chunk_units(query: Column) -> Column:
    """A chunk search's terms in order, each as its index tokens with one space between: what has to follow each other in a text."""
    units = F.transform(phrase_terms(query), lambda t: F.array_join(index_tokens(t), " "))
    return F.filter(units, lambda u: u != "")


def prefix_terms(query: Column) -> Column:
    """Terms of a section search in order; each stands for all tokens that begin with it. A query without one is an error."""
    terms = index_tokens(F.coalesce(query, F.lit("")))
    return F.when(F.size(terms) > 0, terms).otherwise(F.raise_error(F.lit("empty search")).cast("array<string>"))


def query_key(query: Column) -> Column:
    """Sorted distinct tokens: two searches with equal keys count as the same."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(query))), " ")


def any_of(text: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def route(query: Column) -> Column:
    """keyword, conceptual or balanced, by the first signal that holds."""
    q = F.btrim(query)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    dotted = F.exists(words, lambda w: (F.length(w) >= 3) & w.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.]*\.[A-Za-z0-9_.]*[A-Za-z0-9_]$"))
    code = any_of(q, ("`", "::", "()", "->", "_", "/")) | dotted
    quote = any_of(q, ('"', "「", "'"))
    acronym = q.rlike(r"(^|[^A-Za-z0-9])[A-Z]{2,6}($|[^A-Za-z0-9])")
    concept = any_of(F.lower(q), CONCEPT_MARKERS) & (F.size(words) >= 2)
    return F.when(code | quote, "keyword").when(concept, "conceptual").when((F.size(words) <= 3) & acronym, "keyword").otherwise("balanced")


def route_weights(route_class: Column) -> tuple[Column, Column]:
    """(vector, text) fusion weights of a query class."""
    vec = F.when(route_class == "keyword", 0.7).when(route_class == "conceptual", 1.3).otherwise(1.0)
    fts = F.when(route_class == "keyword", 1.3).when(route_class == "conceptual", 0.7).otherwise(1.0)
    return vec, fts


def is_followup(text: Column) -> Column:
    """Whether a message leans on the answer before it. Lengths are in characters."""
    t = F.btrim(text)
    return F.when(F.length(t) < 2, F.lit(False)).when((F.length(t) <= 6) & any_of(t, SHORT_WH), F.lit(True)).otherwise(any_of(t, FOLLOWUP_HINTS))


def self_reports(text: Column) -> Column:
    """The phrases of overconfidence found, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, SELF_REPORTS)), lambda p: F.contains(low, p))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def progress_gap_severity(citation: Column, progress: Column, digits: int | None = None) -> Column:
    """Null unless citation mean and progress are 0.3 apart or more; with ``digits`` the distance is rounded first, so that 0.7 and 0.4 are."""
    gap = F.abs(citation - progress) if digits is None else F.round(F.abs(citation - progress), digits)
    return F.when(gap >= 0.3, clamp(0.5 + (gap - 0.3) / 0.7))


def self_report_severity(text: Column, citation: Column) -> Column:
    """Null unless a phrase is found while the citation mean (0 if unknown) is 0.4 or less."""
    mean = F.coalesce(citation, F.lit(0.0))
    return F.when((F.size(self_reports(text)) > 0) & (mean <= 0.4), clamp(0.5 + 0.4 - mean))


def is_page_line(line: Column) -> Column:
    """Whether a line is only a page number: bare, between dashes or bullets, or with a page word."""
    number = r"[0-9]{1,4}"
    worded = rf"(?:[Pp][Aa][Gg][Ee]|[Pp]\.|[Pp])\s*{number}|(?:페이지|쪽|면)\s*{number}|{number}\s*(?:페이지|쪽|면)"
    return F.btrim(line).rlike(rf"^[-—–·• ]*(?:{number}|{worded})[-—–·• ]*$")


def clean_line(line: Column) -> Column:
    """Control characters out, inner white space to one space, ends trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(line, r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"[ \t]+", " "))


def clean_lines(text: Column) -> Column:
    """The lines of a passage, cleaned, without page-number lines."""
    return F.filter(F.transform(F.split(text, "\n"), clean_line), lambda x: ~is_page_line(x))


def join_clean(lines: Column) -> Column:
    """Lines to one passage: blank runs to one, words hyphenated over a line break joined, ends trimmed."""
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?<=[a-z])- *\n *(?=[a-z])", "")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def clean_passage(text: Column) -> Column:
    return join_clean(clean_lines(text))


def is_sentence_end(line: Column) -> Column:
    return line.rlike(r"(?:[.!?。！？]|다)$")


def markers(answer: Column) -> Column:
    """The numbers of all [S<n>] markers, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[S([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("long"))


def sentences(text: Column) -> Column:
    """Sentences up to a full stop, mark or line end."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?。\n]+[.!?。]?"), F.lit(0)), F.btrim), lambda s: s != "")


def shares_six(sentence: Column, source: Column) -> Column:
    """0.6 if six characters in a row of the sentence occur in the source, else 0; 0 for shorter sentences."""
    n = F.length(sentence)
    hit = F.exists(F.sequence(F.lit(1), F.greatest(n - 5, F.lit(1))), lambda i: F.contains(source, F.substring(sentence, i, 6)))
    return F.when(n < 6, 0.0).when(hit, 0.6).otherwise(0.0)


def answer_in_source(answer: Column, source: Column) -> Column:
    """As ``shares_six``, but an answer of under six characters has to be contained whole."""
    return F.when(F.length(answer) >= 6, shares_six(answer, source)).when(F.contains(source, answer) & (answer != ""), 0.6).otherwise(0.0)


def verdict(score: Column) -> Column:
    return F.when(score >= 0.5, "pass").when(score >= 0.4, "low").otherwise("no_match")


def truncate_lines(text: Column, limit: int) -> Column:
    """Cut at ``limit`` characters, back to the last line end, with a line that tells so."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r"\n[^\n]*$", ""), F.lit("\n…")))


def title_of(text: Column, limit: int = 40) -> Column:
    """A placeholder title: one line, cut with an ellipsis."""
    line = F.btrim(F.regexp_replace(text, r"\n", " "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def slug(title: Column) -> Column:
    """A section's path part: runs of other than letters and digits to one dash."""
    s = F.regexp_replace(F.regexp_replace(F.btrim(title), r"[^\p{L}\p{N}]+", "-"), r"-+$", "")
    return F.concat(F.lit("§"), F.when(s == "", "untitled").otherwise(s))


def chapter_slug(n: Column) -> Column:
    return F.concat(F.lit("Ch"), F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")))


def chapter_number(title: Column) -> Column:
    """The chapter number that a title states, or null."""
    t = F.lower(F.btrim(title))
    found = [F.regexp_extract(t, p, 1) for p in (r"^chapter\s+([0-9]{1,9})(?![0-9])", r"^ch\.?\s*([0-9]{1,9})(?![0-9])", r"^제\s*([0-9]{1,9})(?![0-9])", r"^([0-9]{1,9})\s*(?:장|$)")]
    return F.coalesce(*[F.nullif(f, F.lit("")).cast("int") for f in found])


def first_line(text: Column, limit: int) -> Column:
    return F.substring(F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", ""), 1, limit)


def maskable(text: Column) -> Column:
    """Letter and digit runs of two or more characters."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def significant(text: Column) -> Column:
    return F.filter(maskable(text), lambda w: ~w.isin(*STATUS_WORDS))


def normal_answer(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def response_key(book: Column, query: Column, chunk_ids: Column, model: Column) -> Column:
    """Cache key of an answer; the order of the chunk ids doesn't matter."""
    ids = F.array_join(F.transform(F.array_sort(chunk_ids), lambda x: x.cast("string")), ",")
    return sha(F.concat_ws("\x1f", book, query, ids, model))


def embedding_key(text: Column, model: Column) -> Column:
    return sha(F.concat(text, F.lit(":"), model))


def valid_name(name: Column) -> Column:
    """Folder-safe: no reserved character or name, at most 200 bytes, no space or dot at an edge."""
    return (F.octet_length(name).between(1, 200)) & ~name.rlike(r'[/\\:*?"<>|\x00-\x1f]') & ~name.rlike(r"^[ .]|[ .]$") & ~F.lower(name).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$")


def provider_of(model: Column) -> Column:
    """Back-fill: a model name's prefix tells its provider."""
    of = lambda *starts: F.coalesce(model.rlike(f"^({'|'.join(starts)})-"), F.lit(False))
    return F.when(of("claude"), "anthropic").when(of("gpt", "o1", "o3"), "openai").when(of("gemini"), "gemini")


def hardware_tier(cores: Column, ram_gb: Column) -> Column:
    return F.when((cores < 4) | (ram_gb < 8), "minimum").when(ram_gb < 16, "t1").when(ram_gb < 32, "t2").otherwise("t2_reranker")


def pause_priority(reason: Column) -> Column:
    return F.when(reason == "user", 4).when(reason == "quit", 3).when(reason == "thermal", 2).when(reason == "battery", 1).when(reason == "chat", 0)


def may_pause(current: Column, new: Column) -> Column:
    """Whether a new reason to pause overrides the current one: only a strictly higher priority does, or any if there is none."""
    return F.coalesce(pause_priority(new) > F.coalesce(pause_priority(current), F.lit(-1)), F.lit(False))


def blank_null(text: Column) -> Column:
    """Null for a blank string: a blank section path reads as none."""
    return F.when(F.btrim(text, F.lit(" \t\n\r")) != "", text)


def query_prefixed(text: Column, tier: int) -> Column:
    """A query as the first tier's embedder wants it; the second takes it as it is."""
    return F.concat(F.lit("query: "), text) if tier == 1 else text


def passage_prefixed(text: Column, tier: int) -> Column:
    return F.concat(F.lit("passage: "), text) if tier == 1 else text


def heading_plan(text: Column) -> Column:
    """Array of (level, label) of the ATX headings of a text, fences and underlined headings not looked at."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"^ {0,3}#{1,6}([ \t]|$)"))
    mark = lambda x: F.regexp_extract(x, r"^ {0,3}(#{1,6})", 1)
    label = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"^ {0,3}#{1,6}[ \t]*", ""), r"(^|[ \t]+)#+[ \t]*$", ""))
    return F.transform(lines, lambda x: F.struct(F.length(mark(x)).alias("level"), label(x).alias("label")))


def json_object(text: Column) -> Column:
    """From the first brace to the last, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def unquoted_line(text: Column, label: str = "") -> Column:
    """A model's one-line answer: trimmed, first line, label and one layer of quotes off; null if blank."""
    line = F.btrim(F.substring_index(F.btrim(text, F.lit(" \n\r\t")), "\n", 1))
    if label:
        line = F.btrim(F.regexp_replace(line, rf"^(?i:{label})\s*:\s*", ""))
    return F.nullif(F.regexp_replace(line, r'^"(.*)"$', "$1"), F.lit(""))
