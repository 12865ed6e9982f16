"""The queries of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import twins
from textloom.llm.ann import nearest
from textloom.llm.bpe import round_trip_digest
from textloom.llm.common import table
from textloom.llm.decontaminate import contamination_digest
from textloom.llm.langid import identify_documents
from textloom.llm.merkle import manifest_digest
from textloom.llm.packing import Capacity, pack_documents
from textloom.llm.pii import pii_digest
from textloom.llm.repeats import remove_repeats
from textloom.llm.secrets import secret_digest
from textloom.llm.simhash import near_components
from textloom.llm.toxicity import score_documents
from textloom.llm.trie import prefix_trie
from textloom.llm.urls import ALLOW, BLOCK, UrlRule, judge_urls

URL_RULES = (
    UrlRule("org", "/", ALLOW),
    UrlRule("example.org", "/es/", BLOCK),
    UrlRule("example.org", "/en/1", BLOCK),
    UrlRule("com", "/fr/", ALLOW),
    UrlRule("com", "/de/", BLOCK),
)
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# Documents and attention cost are bounded by the tokens alone, so they forbid nothing and only break ties.
SEQUENCE = Capacity(tokens=4096)
END_ID = 1
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digest(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER, SEQUENCE, end_id=END_ID)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": twins.url_filter([(r.host, r.path, r.verdict) for r in URL_RULES]),
        "op2_pii": twins.PII,
        "op7_secrets": twins.SECRETS,
        "op8_decontaminate": twins.DECONTAMINATE,
        "op11_merkle": twins.MERKLE,
        "op13_prefix_trie": twins.PREFIX_TRIE,
    }
