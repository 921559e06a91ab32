"""A training-data pipeline: each stage takes the documents its predecessor kept and returns what it keeps.

``run`` writes each stage's result as Parquet in the shared checkpoint folder and reads it again, so a
lost executor costs the stage that it was lost in and no more. A stage's folder goes once its
successor's is written; the last one stays, as the result is read from it.

In every stage null texts count as empty, whole texts are looked at however long they are, an empty
table gives an empty one, rows that repeat are treated alike, and columns beside doc_id and text may
have any name and pass through (n_chars, if there, follows the text).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import common, decontaminate, pieces, secrets, simhash_near, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold.

    The model is fitted on the labelled ones of ``docs`` that aren't held out. A row is judged by its
    text alone: null and empty texts like any text without words, equal texts alike. Without labels of
    both classes nothing is dropped. A score at the threshold is dropped.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more).

    That with the smallest doc_id stays; of equal ids, and of null ones, which come last, the least text
    hash, then the least hash of the row; of rows equal in all columns one. Texts without a word (null
    and empty ones too) are one group.
    """
    return simhash_near.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window (ten words of an item, or a shorter item whole).

    A row is judged by its text alone; null and empty texts stay, and so does everything if the
    benchmark is empty.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked; overlapping spans give one mark, null texts stay null."""
    return secrets.redact(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of each document; null and empty texts have no ids, and other columns end here."""
    return pieces.tokenize(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", to_pieces),
]

#: The stages rest on fitted models and hashes that SQL doesn't have; tests hold run() against brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    common.ensure_checkpoint_dir(spark)
    folder, before = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before:
            _removed(spark, before)
        before = f"{folder}/{name}"
    return docs
