"""The tables' history as numbered steps over a store: what each step makes, which columns it adds and how it fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X
from .schemas import DDL, schema
from .sources.snapshots import Change, Snapshot, Store, migrate

# The step that makes a table, and the columns that a later step adds to it.
MADE = {
    1: ("failed_llm_jobs",),
    2: ("studies", "chat_messages", "books"),
    3: ("paragraphs",),
    4: ("intervention_signals", "search_history", "consistency_check_log"),
    5: ("pomodoro_cycles",),
    6: ("srs_cards",),
    7: ("recall_challenges",),
    13: ("chunks", "vectors_t1", "indexing_jobs"),
    14: ("ab_compare_choices",),
    15: ("vectors_t2", "embedding_cache", "response_cache"),
    19: ("memory_facts", "memory_fact_chunks"),
    21: ("recall_attempts",),
    22: ("chunk_entities",),
    23: ("chat_sessions",),
}
ADDED = {
    8: {"books": ("thumbnail_path",)},
    9: {"studies": ("thumbnail_path",)},
    11: {"studies": ("description",)},
    12: {"chat_messages": ("context_json",)},
    15: {"chunks": ("embed_status_t1", "embed_status_t2", "embed_attempts", "last_error"), "indexing_jobs": ("pause_reason", "updated_at")},
    18: {"chat_messages": ("provider",)},
    20: {"srs_cards": ("source_chunk_id", "generation_method", "citation_score")},
    23: {"chat_messages": ("session_id",)},
}
LAST = 23


def _studies_of_jobs(change: Change, was: Snapshot) -> DataFrame:
    """Step 2: a study for each one that a failed job names."""
    jobs = was.read("failed_llm_jobs").groupBy("study_slug").agg(F.min("created_at").alias("created_at"))
    return jobs.select(F.col("study_slug").alias("slug"), F.col("study_slug").alias("name"), F.lit("ko").alias("language"), "created_at", F.lit(None).cast("timestamp_ntz").alias("last_opened"), F.lit(False).alias("is_active"))


def _visible_thumbnails(df: DataFrame) -> DataFrame:
    """Step 10: thumbnails moved out of a hidden folder."""
    return df.withColumn("thumbnail_path", F.replace("thumbnail_path", F.lit("/.thumbnails/"), F.lit("/thumbnails/")))


def _sessions(was: Snapshot) -> DataFrame:
    """Step 23: one session for all earlier messages of a study."""
    told = was.read("chat_messages").groupBy("study_slug").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return told.select(F.concat(F.lit("legacy-"), "study_slug").alias("id"), "study_slug", F.lit("이전 대화").alias("title"), "created_at", "updated_at")


#: What a new column holds in the rows that are there, if not null: (step, table, column) -> rows with it.
FILLED: dict[tuple[int, str, str], Callable[[DataFrame, Snapshot], DataFrame]] = {
    (15, "chunks", "embed_status_t1"): lambda df, was: df.join(was.read("vectors_t1").select(F.col("chunk_id").alias("id"), F.lit("done").alias("_done")).distinct(), "id", "left").withColumn("embed_status_t1", F.col("_done")).drop("_done"),
    (15, "chunks", "embed_attempts"): lambda df, was: df.withColumn("embed_attempts", F.lit(0)),
    (18, "chat_messages", "provider"): lambda df, was: df.withColumn("provider", X.provider_of(F.col("model"))),
    (20, "srs_cards", "generation_method"): lambda df, was: df.withColumn("generation_method", F.lit("legacy")),
    (23, "chat_messages", "session_id"): lambda df, was: df.withColumn("session_id", F.concat(F.lit("legacy-"), "study_slug")),
}


def columns_at(table: str, step: int) -> list[str]:
    """The columns that ``table`` has after ``step``."""
    later = {c for n, tables in ADDED.items() if n > step for c in tables.get(table, ())}
    return [c for c in schema(table).names if c not in later]


def _shaped(df: DataFrame, table: str, step: int) -> DataFrame:
    kinds = schema(table)
    return df.select(*(F.col(f"`{c}`").cast(kinds[c].dataType).alias(c) if c in df.columns else F.lit(None).cast(kinds[c].dataType).alias(c) for c in columns_at(table, step)))


def step(number: int) -> Callable[[Change, Snapshot], None]:
    """The change that ``number`` makes: new columns with their back-fills, then new tables with theirs."""

    def run(change: Change, was: Snapshot) -> None:
        spark = change.store.spark
        for table, added in ADDED.get(number, {}).items():
            df = was.read(table)
            for column in added:
                fill = FILLED.get((number, table, column))
                df = fill(df, was) if fill else df
            change.overwrite(table, _shaped(df, table, number))
        if number == 10:
            for table in ("studies", "books"):
                change.overwrite(table, _visible_thumbnails(was.read(table)))
        for table in MADE.get(number, ()):
            kinds = T.StructType([schema(table)[c] for c in columns_at(table, number)])
            rows = _studies_of_jobs(change, was) if (number, table) == (2, "studies") else _sessions(was) if table == "chat_sessions" else spark.createDataFrame([], kinds)
            change.append(table, _shaped(rows, table, number))

    return run


def upgrade(store: Store, last: int = LAST) -> list[int]:
    """Bring a store to the schema of step ``last``; returns the steps applied now. Rows stay, and a step is applied once."""
    return migrate(store, {n: step(n) for n in range(1, last + 1)})


assert set(DDL) == {t for tables in MADE.values() for t in tables}
