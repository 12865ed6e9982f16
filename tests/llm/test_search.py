"""Near copies, repeats, decontamination and neighbours against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import common, repeats, simhash
from textloom.llm.ann import learn_coder, nearest
from textloom.llm.components import components
from textloom.llm.decontaminate import contamination, contamination_digest
from textloom.llm.queries import op4_ann
from textloom.llm.secrets import scan_secrets


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 580)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(600, pairs)
    assert all(want[node] == root for node, root in got.items())
    assert {x for p in pairs if p[0] != p[1] for x in p} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_grow_with_the_corpus_are_not_broadcast(spark, monkeypatch):
    def joins(df):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        return [line for line in lines if "Join" in line]

    # Spark takes 64 variants of a fingerprint to be as large as the fingerprint.
    found = joins(simhash.links(spark.createDataFrame([(v,) for v in range(9)], "fingerprint long")))
    assert found and all("SortMergeJoin" in line for line in found)
    words = " ".join(map(str, range(12)))
    text = spark.createDataFrame([(1, words + ' token="abcdef123"', "a")], "doc_id long, text string, source string")
    assert [line for line in joins(scan_secrets(text)) if "Inner" in line and "SortMergeJoin" not in line] == []
    # A benchmark too large to be broadcast; each hit holds its whole text.
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    hits = contamination(text, spark.createDataFrame([("i", words)], "item_id string, text string"))
    assert [line for line in joins(hits) if "Inner" in line and "SortMergeJoin" not in line] == []
    assert [tuple(r) for r in hits.select("hit_words", "items").collect()] == [([*range(1, 13)], ["i"])]
    # Equal rows make a small file, which Spark takes to be the size of its rows.
    docs = spark.createDataFrame([(1, "one two three four")] * 50, "doc_id long, text string")
    placed = simhash.near_components(docs)
    assert "SortMergeJoin" in joins(placed)[0]
    assert [tuple(r) for r in placed.select("doc_id", "component_id").collect()] == [(1, 1)] * 50


@pytest.mark.parametrize("block,narrow,bits", [(4096, 16, 3), (40, 4, 3), (4096, 16, 1)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block, narrow, bits):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "_NARROW", narrow)
    draw = random.Random(6)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 30])):
            x = centre
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            values.add(x)
    # Many that share a half, so that a variant has several blocks.
    values |= {(7 << 32) | draw.getrandbits(12) for _ in range(150)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), bits).collect()
    place = {v: i for i, v in enumerate(signed)}
    linked = [(place[r.a], place[r.b]) for r in found]
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= bits]
    assert roots(len(values), linked) == roots(len(values), near)


def test_fingerprints(spark):
    texts = ["", "One", "one two", "a B c d", " a\tb\nc d  e f g " * 30, "x y z " * 70000, "é ü", "ÀB c d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._id: r.fingerprint % (1 << 64) for r in simhash.fingerprints(rows).collect()}
    for i, text in enumerate(texts):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
        grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), text[:20]


def test_one_row_of_each_group(spark):
    rows = [(3, "same words in here", 1), (2, "same words in here", 1), (2, "same words in here", 0), (None, "same words in here", 2), (None, "other text stands alone", 0)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(map(tuple, got), key=repr) == [(2, "same words in here", 0), (None, "other text stands alone", 0)]


@pytest.mark.parametrize("variants,unit", [(2048, 1 << 21), (2, 500)])
def test_repeats(spark, monkeypatch, variants, unit):
    monkeypatch.setattr(repeats, "MOST_VARIANTS", variants)
    monkeypatch.setattr(repeats, "UNIT_BYTES", unit)
    monkeypatch.setattr(repeats, "repeated_windows", lambda texts, window=12, gram=5, inner=repeats.repeated_windows: inner(texts, window, gram))
    draw = random.Random(7)
    passages = ["".join(draw.choice("abcé") for _ in range(n)) for n in (8, 12, 13, 20, 40, 90)]
    texts = ["", "a" * 11, "a" * 12, "a" * 60, None]
    for _ in range(60):
        texts.append("".join(draw.choice([*passages, "".join(draw.choice("abcd") for _ in range(9))]) for _ in range(draw.randint(1, 6))))
    texts += texts[20:24]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + 12] for t in raw for i in range(len(t) - 11))
    for row in repeats.remove_repeats(rows, window=12).collect():
        text = raw[row.doc_id]
        gone = [any(seen[text[i:i + 12]] > 1 for i in range(max(0, at - 11), min(at, len(text) - 12) + 1)) for at in range(len(text))]
        assert bytes(row.kept) == bytes(b for b, g in zip(text, gone) if not g)
        assert row.n_removed == sum(gone) and row.n_bytes == len(text)
        assert row.n_spans == sum(g and not p for g, p in zip(gone, [False, *gone]))


def test_long_texts_are_cut_without_loss():
    text = bytes(random.Random(8).choices(b"abcd", k=5000))
    got = set()
    limit, repeats.PIECE = repeats.PIECE, 1000
    try:
        for rows, data, first, last, base in repeats._pieces([b"", text, text[:399], text[:400]], 400):
            for r, f, l, b in zip(rows, first, last, base):
                got |= {(r, b + i) for i in range(l - f - 399)}
                assert bytes(data[f:l]) == [b"", text, text[:399], text[:400]][r][b:b + l - f]
    finally:
        repeats.PIECE = limit
    assert got == {(1, i) for i in range(4601)} | {(3, 0)}


def test_decontamination(spark):
    draw = random.Random(9)
    vocabulary = ["a", "b", "É", "é", "x1"]
    items = [" ".join(draw.choices(vocabulary, k=k)) for k in (3, 4, 10, 11, 14, 14)] + ["", None, "?!"]
    texts = ["".join(w + draw.choice([" ", ", ", "\n"]) for w in draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(80)]
    texts += [f"{x} {i}".upper() for x in texts[:3] for i in items[:5]] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def words(text):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        return "".join(c if not c.isascii() or c.isalnum() else " " for c in lowered).split(" ") if text else []

    def clean(text):
        return [w for w in words(text) if w]

    for row in contamination_digest(docs, bench).collect():
        own, hit, found = clean(texts[row.doc_id]), set(), set()
        for i, item in enumerate(items):
            iw = clean(item)
            size = min(10, len(iw))
            for k in range(len(iw) - size + 1) if iw else ():
                for at in range(len(own) - size + 1):
                    if own[at:at + size] == iw[k:k + size]:
                        hit |= set(range(at, at + size))
                        found.add(str(i))
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (len(own), len(hit), len(found), bool(hit))


def test_neighbours_recall(spark, sf_dir):
    got = op4_ann(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, points = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    hits = total = 0
    for query in ids[ids % 100 == 0]:
        far = np.sqrt(((points - points[ids == query]) ** 2).sum(axis=1))
        far[ids == query] = np.inf
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert np.allclose([r.score for r in mine], [far[ids == r.vec_id][0] for r in mine], rtol=0, atol=1e-12)
        hits += len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, far))[:10]]))
        total += 10
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]),
            (None, [1.0, 1.0]), (8, [1.0]), (9, []), (10, [3.0, 5.0]), (10, [3.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1)).withColumn("score", F.lit(1))
    got = [tuple(r) for r in nearest(table, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 10, 5.0)]
    assert nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_radius_reaches_the_sample():
    points = np.random.default_rng(0).normal(size=(300, 16))
    coder = learn_coder(points, 5)
    assert coder.codes(points).shape == (300, 4) and 0 < coder.radius <= 32
