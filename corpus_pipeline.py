"""A corpus made ready for training in five stages; each works on all that the one before it kept.

All stages read whole texts of any length and null texts as empty ones, keep columns of other names (also of names that
an operator uses itself), and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import bayes_join, fm_quality, lsm_dedup, mixing, sp_wfst
from quadloom.llm.common import fresh, read, stored
from quadloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.3 or more, with their columns.

    A null or empty text is scored by its structure, a null n_chars is a value of its own; other nulls don't matter.
    Repeated rows get equal scores, so all or none stay. Without labels every document stays.
    """
    model = fm_quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "_quality")
    return docs.withColumn(score, fm_quality.quality_score(docs, model)).where(F.col(score) >= 0.3).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id.

    Null and empty texts are equal. A null id loses to any other; of rows that tie (repeated rows, or a group without any
    id) one stays.
    """
    return lsm_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard index of 0.8 or more over five-word shingles, the document with the smallest doc_id.

    Texts without words link with nothing and stay, as do rows without an id. Rows that repeat an id are one document: all
    or none stay.
    """
    return bayes_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source of its own; texts without words are taken 0 times. Rows without an id draw by their texts;
    ties go by id and size; rows that repeat an id are taken as often as the one that is taken most.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text: doc_id, n_tokens, ids, ids_sha256, round_trip.

    A null or empty text has no pieces, a null id stays null, repeated rows are encoded each; there are no ties.
    """
    return sp_wfst.encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the fitted classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
