"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm.bpe import decode_ids, encode_texts, round_trip_digest
from textloom.llm.decontaminate import contamination_digest, without_contaminated
from textloom.llm.langid import identify_documents
from textloom.llm.pii import pii_digest
from textloom.llm.queries import URL_RULES, VOCABULARY
from textloom.llm.repeats import remove_repeats
from textloom.llm.secrets import scan_secrets, secret_digest, without_secrets
from textloom.llm.simhash import near_components, one_of_each
from textloom.llm.toxicity import fit, score_documents, without_toxic
from textloom.llm.urls import judge_urls

LONG = "word soup with token = abcdef123456 and me@here.example.com " * 4000
TEXTS = [
    (1, "Some words that are here", "en"), (1, "Some words that are here", "en"), (2, None, None), (3, "", "en"),
    (None, "an orphan text", "de"), (None, None, None), (4, LONG, "en"), (5, "1" * 50_000, "fr"), (6, "\n\t  ", "fr"),
    (7, "ünïcödé \U0001F600 " * 9, "de"), (8, "a@" + "b." * 9000 + "c", None),
]
CLASHES = (
    "row_key", "_id", "_text", "_words", "id", "content", "anchor", "at", "n", "hash", "size", "gram", "items", "secrets", "live",
    "_live", "_key", "_row", "_rank", "digest", "owners", "fingerprint", "root", "node", "variant", "score", "predicted", "host",
    "path", "rule", "verdict", "token", "spans", "pii", "ranges", "_hit_key", "_live_key", "_kept_key", "component_id", "place",
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def side(spark):
    return {
        "labels": spark.createDataFrame([(1, 1), (3, 0), (4, 0), (None, 1), (7, None), (1, 0)], "doc_id long, toxic int"),
        "benchmark": spark.createDataFrame([(1, "words that are"), (None, None), (2, ""), (3, "?!")], "item_id long, text string"),
    }


OPERATORS = {
    "pii": lambda d, s: pii_digest(d),
    "bpe": lambda d, s: round_trip_digest(d, VOCABULARY, public_tokenizers.PATTERN),
    "toxicity": lambda d, s: score_documents(d, s["labels"]),
    "repeats": lambda d, s: remove_repeats(d),
    "secrets": lambda d, s: secret_digest(d),
    "decontaminate": lambda d, s: contamination_digest(d, s["benchmark"]),
    "language": lambda d, s: identify_documents(d),
    "simhash": lambda d, s: near_components(d).drop("row_key", "keeper"),
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, side, name):
    run = OPERATORS[name]
    found = rows(run(docs, side))
    assert len(found) == len(TEXTS)
    # Extra columns change nothing, whatever their names.
    clashing = docs.select("*", *(F.lit("x").alias(c) for c in CLASHES))
    if name != "simhash":
        assert rows(run(clashing, side)) == found
    by_id = {r[0]: r[1:] for r in found if r[0] is not None}
    if name != "simhash":
        assert by_id[2] == by_id[3] or name == "toxicity" and by_id[2][1:] == by_id[3][1:]
    assert [r for r in found if r[0] == 1][0] == [r for r in found if r[0] == 1][1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, side, name):
    empty = {k: v.limit(0) for k, v in side.items()}
    found = OPERATORS[name](docs.limit(0), empty)
    assert found.collect() == [] and found.columns


def test_rows_that_stay_whole(docs, side):
    clashing = docs.select("*", *(F.lit("x").alias(c) for c in CLASHES))
    for kept in (without_contaminated(clashing, side["benchmark"]), without_secrets(clashing), one_of_each(clashing),
                 without_toxic(clashing, fit(docs.limit(0).selectExpr("1 AS toxic", "array('a') AS words", "array(1) AS counts").toArrow()))):
        assert kept.columns == clashing.columns
        assert kept.count() <= len(TEXTS)


def test_urls(spark):
    odd = [(1, None, "h"), (1, None, "h"), (2, "", None), (None, "http://A.ORG/x?y", ""), (3, "no scheme", ""), (4, "https://a.com/fr/" + "q" * 99999, "")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    found = rows(judge_urls(pages, URL_RULES))
    assert len(found) == len(odd)
    assert (1, "", "", None, "allow") in found and (3, "", "", None, "allow") in found
    assert (None, "a.org", "/x", "org/", "allow") in found
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}


def test_encoded_null(spark, docs):
    coded = encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN)
    back = decode_ids(coded, VOCABULARY, public_tokenizers.PATTERN)
    want = sorted(((t[0], (t[1] or "").encode()) for t in TEXTS), key=repr)
    assert sorted(((r.doc_id, bytes(r.content)) for r in back.collect()), key=repr) == want
    assert scan_secrets(docs).count() == len(TEXTS)
