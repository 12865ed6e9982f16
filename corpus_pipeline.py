"""The training-data pipeline: what it rejects goes, what it keeps stays whole.

``run`` applies the stages of STAGES to the documents in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe import round_trip_digest
from textloom.llm.common import kept, table
from textloom.llm.decontaminate import without_contaminated
from textloom.llm.queries import VOCABULARY
from textloom.llm.secrets import without_secrets
from textloom.llm.simhash import one_of_each
from textloom.llm.toxicity import learn_toxicity, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from this table's labels, rejects are gone."""
    return without_toxic(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark are gone."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are replaced; every document stays."""
    return without_secrets(docs, n_chars="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return round_trip_digest(docs, VOCABULARY, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

# A fitted classifier decides in the first stage, so there is no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that every stage keeps, encoded.

    What a stage keeps is written once and read by the next, so no stage runs twice and
    a lost executor costs no earlier stage.  Null texts count as empty, null ids are
    ids, repeated rows are near copies of each other, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
