"""The Merkle manifest against a plain tree, and against its SQL twin."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import twins
from textloom.llm.merkle import fold, leaf, manifest, manifest_digest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def plain_tree(digests, arity):
    """(root, proofs): each proof is a list of (before, after)."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for proof, i in zip(proofs, at):
            first = i - i % arity
            proof.append(("".join(level[first:i]), "".join(level[i + 1:first + arity])))
        at = [i // arity for i in at]
        level = [digest(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return level[0], proofs


def plain(rows, arity=3):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]], arity)
    root, above = plain_tree([trees[g][0] for g in order], arity)
    out = []
    for g, upper in zip(order, above):
        for row, lower in zip(groups[g], trees[g][1]):
            proof, copy = lower + upper, dict(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                copy["text"] = row["text"].replace("\n", "")
            folded = plain_leaf(copy)
            for before, after in proof:
                folded = digest(before, folded, after)
            out.append((row["doc_id"], plain_leaf(row), trees[g][0], root, digest(*[b + a for b, a in proof]), folded, folded == root))
    return sorted(out, key=repr)


def table(seed, sizes):
    draw = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "one\ntwo", "é\n\n", "x" * draw.randint(1, 3000)])
            rows.append((len(rows), text, draw.choice([None, "de", ""]), source, draw.choice([None, 7])))
    draw.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def as_dicts(rows):
    return [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows]


CASES = [
    table(1, {"a": 40, None: 5, "": 1, "b": 1, "ä": 3, "Z": 9, "hot": 90} | {f"s{i}": 1 + i % 4 for i in range(9)}),
    table(3, {"only": 1}),
    # Repeated rows and rows without an id.
    [(1, "a\n", "x", "s", 1)] * 5 + [(None, "a\n", "x", "s", 1)] * 2 + [(None, None, None, None, None)],
]


@pytest.mark.parametrize("rows", CASES)
def test_equals_a_plain_tree_and_the_twin(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit("x")).withColumn("place", F.lit("x"))
    found = manifest_digest(docs)
    want = plain(as_dicts(rows))
    assert got(found) == want
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(con.sql(twins.MERKLE).fetchall(), key=repr) == want


def test_another_arity_all_by_shuffle_and_a_change(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.merkle.BROADCAST_BYTES", 0)
    rows = table(7, {"a": 9, None: 2, "b": 1})
    docs = spark.createDataFrame(rows, SCHEMA)
    stored = manifest(docs, COLUMNS, group="source", order=["doc_id"], arity=2, extras={"doc_id": F.col("doc_id")}).cache()
    groups = {}
    for row in sorted(as_dicts(rows), key=lambda r: r["doc_id"]):
        groups.setdefault(row["source"], []).append(plain_leaf(row))
    root, _ = plain_tree([plain_tree(groups[g], 2)[0] for g in (None, "a", "b")], 2)
    assert stored.where(F.col("root") == root).count() == len(rows)
    assert stored.where(fold(F.col("leaf"), F.col("proof")) == root).count() == len(rows)
    changed = docs.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang")))
    now = changed.select("doc_id", leaf([F.col(c) for c in COLUMNS]).alias("now"))
    wrong = stored.join(now, "doc_id").where(fold(F.col("now"), F.col("proof")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [7]


def test_empty_table(spark):
    assert manifest_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_node_of_a_run_needs_two(spark):
    with pytest.raises(ValueError):
        manifest(spark.createDataFrame(CASES[1], SCHEMA), COLUMNS, group="source", order=["doc_id"], arity=1).collect()
