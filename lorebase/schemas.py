"""Table schemas: declared, never inferred, and what a table's rows have to meet."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table and column names.
DDL = {
    "studies": "slug STRING NOT NULL, name STRING NOT NULL, language STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, last_opened TIMESTAMP_NTZ, is_active BOOLEAN NOT NULL, thumbnail_path STRING, description STRING",
    "books": "id STRING NOT NULL, study_slug STRING NOT NULL, role STRING NOT NULL, role_note STRING, title STRING NOT NULL, author STRING, source_path STRING NOT NULL, file_format STRING NOT NULL, file_size BIGINT NOT NULL, file_hash STRING NOT NULL, added_at TIMESTAMP_NTZ NOT NULL, last_modified TIMESTAMP_NTZ, indexed_at TIMESTAMP_NTZ, metadata_json STRING, thumbnail_path STRING",
    "paragraphs": "id BIGINT NOT NULL, book_id STRING NOT NULL, section_path STRING NOT NULL, section_label STRING NOT NULL, chunk_index INT NOT NULL, content STRING NOT NULL, page INT, char_offset INT NOT NULL, created_at TIMESTAMP_NTZ NOT NULL",
    "chunks": "id BIGINT NOT NULL, book_id STRING NOT NULL, ord INT NOT NULL, text STRING NOT NULL, page INT, span_start INT, span_end INT, parent_id BIGINT, prev_chunk_id BIGINT, next_chunk_id BIGINT, section_path STRING, token_count INT, created_at TIMESTAMP_NTZ NOT NULL, embed_status_t1 STRING, embed_status_t2 STRING, embed_attempts INT NOT NULL, last_error STRING",
    "vectors_t1": "chunk_id BIGINT NOT NULL, embedding ARRAY<FLOAT> NOT NULL, created_at TIMESTAMP_NTZ NOT NULL",
    "vectors_t2": "chunk_id BIGINT NOT NULL, embedding ARRAY<FLOAT> NOT NULL, created_at TIMESTAMP_NTZ NOT NULL",
    "chunk_entities": "chunk_id BIGINT NOT NULL, entity STRING NOT NULL, book_id STRING NOT NULL, weight DOUBLE NOT NULL",
    "indexing_jobs": "id BIGINT NOT NULL, book_id STRING NOT NULL, status STRING NOT NULL, tier INT NOT NULL, progress_chunks INT NOT NULL, total_chunks INT, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, error STRING, pause_reason STRING, updated_at TIMESTAMP_NTZ",
    "chat_sessions": "id STRING NOT NULL, study_slug STRING NOT NULL, title STRING, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL",
    "chat_messages": "id BIGINT NOT NULL, study_slug STRING NOT NULL, role STRING NOT NULL, content STRING NOT NULL, section_ref STRING, page_ref INT, created_at TIMESTAMP_NTZ NOT NULL, cache_hit_tokens BIGINT, creation_tokens BIGINT, output_tokens BIGINT, model STRING, cost_usd DOUBLE, context_json STRING, provider STRING, session_id STRING",
    "failed_llm_jobs": "id BIGINT NOT NULL, study_slug STRING NOT NULL, job_type STRING NOT NULL, payload_json STRING NOT NULL, error STRING, attempts INT NOT NULL, last_attempt TIMESTAMP_NTZ, next_retry_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ NOT NULL",
    "intervention_signals": "id BIGINT NOT NULL, study_slug STRING NOT NULL, signal_type STRING NOT NULL, severity DOUBLE NOT NULL, metadata_json STRING, fired_at TIMESTAMP_NTZ NOT NULL, user_dismissed BOOLEAN NOT NULL",
    "search_history": "id BIGINT NOT NULL, study_slug STRING NOT NULL, query STRING NOT NULL, query_norm STRING NOT NULL, result_count INT NOT NULL, searched_at TIMESTAMP_NTZ NOT NULL",
    "consistency_check_log": "id BIGINT NOT NULL, study_slug STRING, check_type STRING NOT NULL, triggered_by STRING NOT NULL, issues_json STRING NOT NULL, checked_at TIMESTAMP_NTZ NOT NULL",
    "pomodoro_cycles": "id BIGINT NOT NULL, study_slug STRING NOT NULL, phase STRING NOT NULL, duration_min INT NOT NULL, started_at TIMESTAMP_NTZ NOT NULL, ended_at TIMESTAMP_NTZ, completed BOOLEAN NOT NULL, interruption STRING",
    "srs_cards": "id BIGINT NOT NULL, study_slug STRING NOT NULL, front STRING NOT NULL, back STRING NOT NULL, section_ref STRING, page_ref INT, e_factor DOUBLE NOT NULL, interval_days INT NOT NULL, repetitions INT NOT NULL, due_date DATE NOT NULL, last_reviewed TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ NOT NULL, source_chunk_id BIGINT, generation_method STRING NOT NULL, citation_score DOUBLE",
    "recall_challenges": "id BIGINT NOT NULL, study_slug STRING NOT NULL, chapter_ref STRING NOT NULL, user_input STRING NOT NULL, keywords_expected ARRAY<STRING> NOT NULL, keywords_present ARRAY<STRING> NOT NULL, keywords_missing ARRAY<STRING> NOT NULL, passed BOOLEAN NOT NULL, challenged_at TIMESTAMP_NTZ NOT NULL",
    "recall_attempts": "id BIGINT NOT NULL, study_slug STRING NOT NULL, chunk_id BIGINT NOT NULL, trigger_id STRING NOT NULL, strength STRING NOT NULL, outcome STRING NOT NULL, fired_at TIMESTAMP_NTZ NOT NULL, responded_at TIMESTAMP_NTZ",
    "memory_facts": "id BIGINT NOT NULL, study_id STRING NOT NULL, kind STRING NOT NULL, content STRING NOT NULL, source STRING NOT NULL, confidence DOUBLE NOT NULL, status STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL",
    "memory_fact_chunks": "fact_id BIGINT NOT NULL, chunk_id BIGINT NOT NULL, similarity DOUBLE NOT NULL",
    "embedding_cache": "text_hash STRING NOT NULL, embedding ARRAY<FLOAT> NOT NULL, model STRING NOT NULL, dim INT NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, last_hit_at TIMESTAMP_NTZ",
    "response_cache": "key STRING NOT NULL, notebook_id STRING NOT NULL, response_text STRING NOT NULL, model STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, last_hit_at TIMESTAMP_NTZ, hit_count BIGINT NOT NULL",
    "ab_compare_choices": "id BIGINT NOT NULL, query_hash STRING NOT NULL, query_text STRING NOT NULL, baseline_text STRING NOT NULL, v041_text STRING NOT NULL, chose STRING NOT NULL, note STRING, handle STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL",
}

# What a column may hold.
ALLOWED = {
    ("books", "role"): ("main", "sub"),
    ("books", "file_format"): ("md", "pdf", "html", "txt", "docx"),
    ("indexing_jobs", "status"): ("queued", "running", "paused", "completed", "failed", "cancelled"),
    ("chat_messages", "role"): ("user", "assistant", "system"),
    ("pomodoro_cycles", "phase"): ("focus", "break"),
    ("recall_attempts", "strength"): ("weak", "medium", "strong"),
    ("recall_attempts", "outcome"): ("correct", "incorrect", "dismissed", "timeout", "skipped"),
    ("memory_facts", "status"): ("active", "archived", "expired"),
    ("ab_compare_choices", "chose"): ("baseline", "v041", "tie"),
}


#: What a column holds where a row gives nothing.
DEFAULTS = {("memory_facts", "status"): "active", ("memory_facts", "confidence"): 0.7, ("books", "role"): "main", ("indexing_jobs", "status"): "queued", ("indexing_jobs", "progress_chunks"): 0, ("failed_llm_jobs", "attempts"): 0, ("response_cache", "hit_count"): 0, ("intervention_signals", "user_dismissed"): False, ("studies", "is_active"): False, ("srs_cards", "e_factor"): 2.5, ("srs_cards", "interval_days"): 0, ("srs_cards", "repetitions"): 0}


@cache
def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """``df`` as rows of ``table``: its columns in order and type, defaults filled in; a row that breaks a rule fails the write.

    Rules: no null in a column that has none, only the values that ALLOWED lists, and, for a column named
    in ``parents``, a key of that one-column table.
    """
    out = df
    for field in schema(table):
        c, name = F.col(f"`{field.name}`"), f"{table}.{field.name}"
        given = c.cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if (default := DEFAULTS.get((table, field.name))) is not None:
            given = F.coalesce(given, F.lit(default).cast(field.dataType))
        if not field.nullable:
            given = F.coalesce(given, F.raise_error(F.lit(f"{name} is missing")).cast(field.dataType))
        if allowed := ALLOWED.get((table, field.name)):
            given = F.when(given.isNull() | given.isin(*allowed), given).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be one of {', '.join(allowed)}: "), given)))
        out = out.withColumn(field.name, given)
    for column, keys in (parents or {}).items():
        known = keys.select(F.col(keys.columns[0]).alias("_key")).distinct().withColumn("_known", F.lit(True))
        out = out.join(known, F.col(column) == F.col("_key"), "left")
        unknown = F.raise_error(F.concat(F.lit(f"{table}.{column} has no parent: "), F.col(column).cast("string")))
        out = out.withColumn(column, F.when(F.col(column).isNull() | F.col("_known"), F.col(column)).otherwise(unknown)).drop("_key", "_known")
    return out.select(*schema(table).names)
