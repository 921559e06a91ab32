"""Libraries, sessions and small maintenance: listings, lookups, names, status changes, snippets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from . import neighbours as N
from .retrieval import sized

# Labels of signal types and markers of errors worth a retry.
SIGNAL_LABELS = {"repeat_search": "같은 검색 반복", "progress_recall_gap": "진도-회상 격차", "self_report_low": "자기보고-실제 격차", "short_dwell": "짧은 체류", "forced_output_miss": "응답 후 정주행 X"}
RETRYABLE = ("timeout", "connection", "HTTP 5", "status 5", "wire")


def lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted ids with the wanted table's columns (rank, score); unknown ids are skipped."""
    return rows.join(sized(ids), key)


def when_given(df: DataFrame, **equal) -> DataFrame:
    """Filter by the arguments that aren't None."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def listing(studies: DataFrame, books: DataFrame) -> DataFrame:
    """Studies with their number of books, the active one first, then by last use."""
    n = books.groupBy("study").agg(F.count("*").alias("books"))
    out = studies.join(n, "study", "left").withColumn("books", F.coalesce("books", F.lit(0)))
    return out.orderBy(F.col("is_active").desc(), F.coalesce("last_opened", "created_at").desc(), "study")


def main_book(books: DataFrame) -> DataFrame:
    """The book of each study that questions go to: a main one before others, the oldest first."""
    w = Window.partitionBy("study").orderBy((F.col("role") == "main").desc(), "added_at", "book")
    return books.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def reading_order(rows: DataFrame, book: str, section: str, order: str) -> DataFrame:
    """(book, section, pos): the sections of each book by where they begin."""
    first = rows.groupBy(book, section).agg(F.min(order).alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(book).orderBy("first", section)))


def latest_or_new(studies: DataFrame, sessions: DataFrame) -> DataFrame:
    """(study, session, created): each study's session that was updated last; a study without one gets a new one."""
    last = sessions.groupBy("study").agg(F.max_by("session", F.struct("updated_at", "id")).alias("session"))
    out = studies.join(last, "study", "left")
    return out.select("study", F.coalesce("session", F.concat(F.lit("new-"), F.col("study").cast("string"))).alias("session"), F.col("session").isNull().alias("created"))


#: A name is tried with so many numbers.
MOST_NAMES = 999


def free_names(wanted: DataFrame, taken: DataFrame, group: str, name: str) -> DataFrame:
    """``wanted`` with ``free``: the name, or the first of ``name (2)`` to ``name (999)`` that ``taken(group, name)`` lacks; an error beyond."""
    number = r" \(([0-9]{1,3})\)$"
    used = taken.select(group, F.regexp_replace("name", number, "").alias("_base"), F.coalesce(F.nullif(F.regexp_extract("name", number, 1), F.lit("")).cast("int"), F.lit(1)).alias("_n"))
    sets = used.groupBy(group, "_base").agg(F.collect_set("_n").alias("_used"))  # 999 at most
    out = wanted.join(sets.withColumnRenamed("_base", name), [group, name], "left")
    first = F.get(F.array_except(F.sequence(F.lit(1), F.lit(MOST_NAMES)), F.coalesce("_used", F.array().cast("array<int>"))), F.lit(0))
    free = F.when(first.isNull(), F.raise_error(F.lit("no free name"))).when(first == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), first.cast("string"), F.lit(")")))
    return out.withColumn("free", free).drop("_used")


def affected(df: DataFrame, ids: DataFrame, status: str, by: str, key: str = "id") -> DataFrame:
    """(by, affected): how many rows of ``df`` a change of ``ids(key, by)`` to ``status`` reaches."""
    hit = df.where(~F.col("status").eqNullSafe(status)).join(sized(ids), key)
    return hit.groupBy(by).agg(F.count("*").alias("affected"))


def pending(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(job, book, n_pending, first_id): running or paused ones of ``jobs(job, book, status)`` whose book has chunks that aren't done; failed ones count again."""
    todo = chunks.where("status is null or status = 'failed'").groupBy("book").agg(F.count("*").alias("n_pending"), F.min("id").alias("first_id"))
    return jobs.where("status in ('running', 'paused')").select("job", "book").join(todo, "book").select("job", "book", "n_pending", "first_id")


def edited(df: DataFrame, edits: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``df`` with ``column`` replaced where ``edits(key, new_<column>)`` has the row, and ``edited``."""
    out = df.join(sized(edits.withColumn("edited", F.lit(True))), key, "left").withColumn("edited", F.coalesce("edited", F.lit(False)))
    return out.withColumn(column, F.when(F.col("edited"), F.col(f"new_{column}")).otherwise(F.col(column))).drop(f"new_{column}")


def fallback(asked: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, kind, context): of each question the context of the first source that has one not blank, else none."""
    found = None
    for place, (kind, rows) in enumerate(sources):
        some = rows.where(F.btrim("context") != "").select("query_id", F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), "context").alias("c"))
        found = some if found is None else found.union(some)
    best = found.groupBy("query_id").agg(F.min("c").alias("c"))
    return asked.join(best, "query_id", "left").select("query_id", F.coalesce("c.kind", F.lit("none")).alias("kind"), "c.context")


def numbered_names(df: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Equal names of a group get (2), (3), ... in order."""
    k = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), k.cast("string"), F.lit(")"))))


def probed(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """``rows`` with ``path``: in order, a name that its group hasn't used, else the first of name-2, name-3, ... that it hasn't.

    Only names that agree without their numbers can get in each other's way, so these stream through one
    task in order. Its state is a counter for each distinct name and the names given as they were, not the
    rows: what a counter has passed is used.
    """
    columns = rows.columns

    def run(it):
        now, given, past = None, set(), {}

        def used(path: str) -> bool:
            if path in given:
                return True
            base, dash, number = path.rpartition("-")
            return bool(dash) and number.isascii() and number.isdigit() and number[0] != "0" and 2 <= int(number) < past.get(base, 2)

        for batch in it:
            paths = []
            for key, base in zip(zip(batch.column("_group").to_pylist(), batch.column("_root").to_pylist(), strict=True), batch.column("_name").to_pylist(), strict=True):
                if key != now:
                    now, given, past = key, set(), {}
                if not used(base):
                    given.add(base)
                    paths.append(base)
                else:
                    k = past.get(base, 2)
                    while f"{base}-{k}" in given:
                        k += 1
                    past[base] = k + 1
                    paths.append(f"{base}-{k}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(paths, pa.string())], names=[*columns, "path"])

    root = F.regexp_replace(F.col(name), r"(-[0-9]+)+$", "")
    dealt = rows.withColumns({"_group": F.col(group).cast("string"), "_root": root, "_name": F.col(name), "_order": F.col(order)})
    dealt = dealt.repartition("_group", "_root").sortWithinPartitions("_group", "_root", "_order")
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, StructField("path", StringType())]))


def with_status(df: DataFrame, ids: DataFrame, status: str, key: str = "id") -> DataFrame:
    """``df`` with the status of the given ids changed."""
    marked = sized(ids.select(key).distinct().withColumn("_hit", F.lit(True)))
    return df.join(marked, key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def retryable(error: Column) -> Column:
    return T.any_of(error, RETRYABLE)


def alert_message(combo: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SIGNAL_LABELS.items() for x in pair])
    names = F.transform(F.split(combo, r"\+"), lambda t: F.coalesce(F.element_at(labels, t), t))
    return F.concat(F.lit("능력 착각 신호: "), F.array_join(names, " + "), F.lit(" 동시 발화"))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """``n`` rows by a seeded hash of the key: a sample that every run repeats."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def snippet(text: Column, terms: Column, width: int = 12) -> Column:
    """The window of ``width`` tokens with the most hits, hits marked << >>, with ellipses where text is left out.

    A window begins at a hit; of equal ones the first counts. Without a hit, the text's first tokens.
    """
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")
    marked = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("w"), F.array_contains(terms, plain(w)).cast("int").alias("m")))

    def shown(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda x, i: F.when(x["m"] == 1, i + 1)), lambda i: i.isNotNull())
        count = lambda i: F.aggregate(F.slice(words, i, F.lit(width)), F.lit(0), lambda s, x: s + x["m"])
        best = F.array_max(F.transform(hits, lambda i: F.struct(count(i).alias("n"), (-i).alias("i"))))
        return T.let(F.coalesce(-best["i"], F.lit(1)).cast("int"), lambda start: cut(words, start))

    def cut(words: Column, start: Column) -> Column:
        some = F.transform(F.slice(words, start, F.lit(width)), lambda x: F.when(x["m"] == 1, F.concat(F.lit("<<"), x["w"], F.lit(">>"))).otherwise(x["w"]))
        return F.concat(F.when(start > 1, "…").otherwise(""), F.array_join(some, " "), F.when(F.size(words) > start + width - 1, "…").otherwise(""))

    return T.let(marked, shown)


def similar_pairs(turns: DataFrame, chunks: DataFrame, floor: float = 0.85, by: str | None = None) -> DataFrame:
    """(turn_id, chunk_id, similarity): all chunks whose cosine to a turn's vector reaches ``floor``; with ``by``, of the turn's study only."""
    own = [by] if by else []
    near = N.within(turns.select(F.col("turn_id").alias("query_id"), *own, "vector"), chunks.select(F.col("chunk_id").alias("id"), *own, "vector"), floor, by)
    return near.select(F.col("query_id").alias("turn_id"), F.col("id").alias("chunk_id"), F.col("score").alias("similarity"))


def first_passing(scores: Column, ids: Column, floor: float = 0.5) -> Column:
    """The id beside the first score that reaches ``floor``; the longer list's rest is left out."""
    return F.get(F.filter(F.arrays_zip(scores.alias("s"), ids.alias("i")), lambda x: (x["s"] >= floor) & x["i"].isNotNull()), F.lit(0))["i"]


def phases(log: DataFrame) -> DataFrame:
    """(study, phase, started_at, ended_at, completed): each start in an event log with the stop that follows it."""
    w = Window.partitionBy("study").orderBy("ts", "id")
    rows = log.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_ts", F.lead("ts").over(w)).where("kind like 'start%'")
    stops = F.col("next_kind") == "stop"
    return rows.select("study", F.substring_index("kind", "_", -1).alias("phase"), F.col("ts").alias("started_at"), F.when(stops, F.col("next_ts")).alias("ended_at"), F.coalesce(stops, F.lit(False)).alias("completed"))


def healed_fences(pieces: Column, most: int = 8000) -> Column:
    """Pieces with an open code fence (lines that begin with ``` or ~~~) joined with their successors until it closes or ``most`` characters are reached."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(False).alias("open"))
    odd = lambda t: F.size(F.filter(F.split(t, "\n"), lambda line: line.rlike(r"^[ \t]*(```|~~~)"))) % 2 == 1

    def step(acc, x):
        text = F.when(acc["open"], F.concat(acc["held"], F.lit("\n"), x)).otherwise(x)
        waits = odd(text) & (F.length(text) < most)
        return F.struct(F.when(waits, acc["out"]).otherwise(F.concat(acc["out"], F.array(text))).alias("out"), F.when(waits, text).otherwise("").alias("held"), waits.alias("open"))

    return F.aggregate(pieces, zero, step, lambda a: F.when(a["open"], F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))


def routed(answer: Column, query: Column) -> tuple[Column, Column]:
    """(rewrite, class) of a two-line model answer; what is missing falls back to the query and to its own class."""
    line = lambda name: F.nullif(F.btrim(F.regexp_extract(answer, rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*(.*)$", 1)), F.lit(""))
    kind = F.lower(line("class"))
    return F.coalesce(line("rewrite"), query), F.when(kind.isin("keyword", "conceptual", "balanced"), kind).otherwise(T.route(query))
