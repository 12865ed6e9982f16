import hashlib
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.operators import mixing as M
from textloom.operators import slices as S
from textloom.operators import tokens as K


def token_rows(spark, lengths):
    rows = [(i, list(range(i * 100 + 1, i * 100 + n + 1)), [1] * n, [-100] + list(range(n - 1)) if n else []) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "row_id bigint, input_ids array<bigint>, attention_mask array<bigint>, labels array<bigint>")


def test_numbering_with_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), ((F.col("id") * 7919) % 5003).alias("x"))
    numbered = S.number_rows(df, ["g"], [F.desc("x")]).collect()
    for g in {r.g for r in numbered}:
        mine = sorted((r for r in numbered if r.g == g), key=lambda r: r.rn)
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1))
        assert [r.x for r in mine] == sorted((r.x for r in mine), reverse=True)
    # The hot group really is spread; so few rows would be merged otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = S.range_slices(df, ["g"], [F.desc("x")])
        again = S._number_within(sliced, ["g"], [F.desc("x")], "rn")
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, numbered))
        per_slice = [r["count"] for r in sliced.where("g = 'hot'").groupBy(S.SLICE).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_slice) > 1 and max(per_slice) < 2000


def test_hash_numbering_is_seeded_and_partition_free(spark):
    df = spark.range(2000)
    a = {r.id: r.rn for r in S.number_by_hash(df.repartition(7), [], F.col("id"), 5).collect()}
    b = {r.id: r.rn for r in S.number_by_hash(df.coalesce(1), [], F.col("id"), 5).collect()}
    c = {r.id: r.rn for r in S.number_by_hash(df, [], F.col("id"), 6).collect()}
    expected = sorted(range(2000), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    assert a == b == {i: n + 1 for n, i in enumerate(expected)} and a != c


def test_first_n_beyond_the_group_limit(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), "id")
    assert S.first_n(df, ["g"], [F.asc("id")], 1500).agg(F.max("id"), F.count("*")).first()[:] == (1499, 1500)


def test_running_before(spark):
    df = spark.range(300).select(F.lit("r").alias("g"), "id", ((F.col("id") * 37) % 101).alias("v"))
    rows = S.running_before(df, ["g"], [F.asc("id")], F.col("v"), "max", "best").orderBy("id").collect()
    best = None
    for r in rows:
        assert r.best == best
        best = r.v if best is None else max(best, r.v)
    with pytest.raises(ValueError):
        S.running_before(df, ["g"], [F.asc("id")], F.col("v"), "mean", "best")


def test_sampling(spark):
    five = spark.range(5).select(F.lit("g").alias("g"), "id")
    assert M.sample_frac(five, ["g"], F.col("id"), 0.5, 1).count() == 2
    assert M.sample_frac(five, ["g"], F.col("id"), 0.01, 1).count() == 1
    assert M.sample_frac(five, ["g"], F.col("id"), 1.0, 1).count() == 5
    for bad in (0.0, 1.5):
        with pytest.raises(ValueError):
            M.sample_frac(five, ["g"], F.col("id"), bad, 1)
    taken = M.sample_rows(five, ["g"], F.col("id"), [F.asc("id")], frac=0.2, n=3)
    assert sorted(r.id for r in taken.collect()) == [0, 1, 2]


def test_split_sizes(spark):
    df = spark.range(50).select(F.lit("g").alias("g"), "id")
    share = M.train_val_split(df, ["g"], F.col("id"), 0.15, 3).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in share} == {"val": 8, "train": 42}
    count = M.train_val_split(df, ["g"], F.col("id"), 7, 3).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in count} == {"val": 7, "train": 43}


def test_mix_does_not_leak(spark):
    data = spark.range(100).select(F.lit("a").alias("name"), "id").unionAll(spark.range(40).select(F.lit("b"), "id"))
    plan = M.plan_table(spark, [M.MixEntry("a", repeat=3, val_ratio=0.2), M.MixEntry("b", role="eval", repeat=2, sample_n=50)])
    mixed = M.dataset_mix(data, plan, ["id"], [F.col("id")], 1).collect()
    train = [r for r in mixed if r.part == "train"]
    val = [r for r in mixed if r.eval_group == "a_val"]
    assert len(train) == 240 and len(val) == 20
    assert not {r.id for r in train} & {r.id for r in val}
    evals = [r for r in mixed if r.eval_group == "b"]
    assert len(evals) == 50 and max(r.id for r in evals) == 24
    leaky = M.dataset_mix(data, plan, ["id"], [F.col("id")], 1, leak_safe=False)
    assert leaky.where("name = 'a'").groupBy("part").count().orderBy("part").collect()[0]["count"] == 60


def test_plan_is_checked(spark):
    with pytest.raises(ValueError):
        M.plan_table(spark, [M.MixEntry("a", role="test")])
    with pytest.raises(ValueError):
        M.plan_table(spark, [M.MixEntry("a", role="eval")])
    with pytest.raises(ValueError):
        M.plan_table(spark, [M.MixEntry("a", sample_frac=2.0)])
    row = M.plan_table(spark, [M.MixEntry("a", metrics=["PPL", "loss"])]).first()
    assert row.metrics == ["loss", "ppl"] and row.chrf_eval_n == 64


def packed_in_python(rows, limit, batch):
    out = []
    for start in range(0, len(rows), batch):
        current = []
        for ids in rows[start:start + batch]:
            if not ids:
                continue
            if current and len(current) + len(ids) > limit:
                out.append(current[:limit])
                current = []
            current = current + ids
        if current:
            out.append(current[:limit])
    return out


def test_packing(spark):
    sizes = [(r.n_rows, len(r.input_ids)) for r in M.pack_sequences(token_rows(spark, [3, 4, 9, 2]), "row_id", 8).orderBy("bin").collect()]
    assert sizes == [(2, 7), (1, 8), (1, 2)]
    lengths = [(i * 7) % 11 for i in range(90)]
    rows = token_rows(spark, lengths)
    expected = packed_in_python([r.input_ids for r in rows.orderBy("row_id").collect()], 20, 16)
    for n in (1, 13):
        packed = M.pack_sequences(rows.repartition(n), "row_id", 20, batch_rows=16).orderBy("batch", "bin").collect()
        assert [r.input_ids for r in packed] == expected
        assert all(len(r.labels) == len(r.attention_mask) == len(r.input_ids) for r in packed)


def test_padding(spark):
    rows = M.pad_batches(token_rows(spark, [3, 9, 2, 17, 8]), ["row_id"], 2, pad_id=7).collect()
    by_id = {r.row_id: r for r in rows}
    assert {i: r.width for i, r in by_id.items()} == {0: 8, 2: 8, 1: 16, 4: 16, 3: 24}
    assert by_id[0].input_ids == [1, 2, 3] + [7] * 5
    assert by_id[0].attention_mask == [1] * 3 + [0] * 5
    assert by_id[0].labels == [-100, 0, 1] + [-100] * 5


def test_array_operators(spark):
    df = spark.createDataFrame([([11, 12, 13, 14, 15], 3), ([11], 3), ([], 0)], "ids array<bigint>, n int")
    rows = df.select(*K.training_row(F.col("ids"), F.col("n"), 4)).collect()
    assert rows[0].labels == [-100, -100, -100, 14] and rows[0].n_supervised == 1
    assert rows[1].labels == [-100] and rows[1].n_supervised == 0
    assert rows[2].labels == []
    prompt, ref = A.split_at_mask(F.col("input_ids"), F.col("labels"))
    split = df.select(*K.training_row(F.col("ids"), F.col("n"), 9)).select(prompt.alias("p"), ref.alias("r")).collect()
    assert (split[0].p, split[0].r) == ([11, 12, 13], [14, 15])
    assert (split[1].p, split[1].r) == ([11], [])
    suffixed = df.select(A.ensure_suffix(F.col("ids"), [14, 15]).alias("s")).collect()
    assert [r.s for r in suffixed] == [[11, 12, 13, 14, 15], [11, 14, 15], [14, 15]]
    total, count = A.masked_logprob(F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0)), F.col("n"))
    sums = df.select(total.alias("t"), count.alias("c"), A.length_norm_score(total, count).alias("s")).collect()
    assert [(r.t, r.c) for r in sums] == [(0.0, 0), (0.0, 0), (-6.0, 3)]
    assert [r.s for r in sums] == [float("-inf"), float("-inf"), -2.0]


def test_vocabulary_and_encoding(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c", "b"])], "k int, t array<string>")
    vocabulary = K.build_vocabulary(df, "t")
    assert sorted((r.id, r.token, r.freq) for r in vocabulary.collect()) == [(0, "b", 3), (1, "a", 1), (2, "c", 1)]
    for limit in (1 << 20, 1):
        monkeypatch.setattr(K, "BROADCAST_BYTES", limit)
        encoded = {r.k: r.input_ids for r in K.encode(df, ["k"], "t", vocabulary).collect()}
        assert encoded == {1: [0, 1, 0], 2: [], 3: [2, 0]}


def test_model_hooks(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "i int, t string")
    ids = K.tokenize(df, "t", lambda: (lambda text: [len(text), 1])).orderBy("i").collect()
    assert [r.input_ids for r in ids] == [[i, 1] for i in range(10)]

    def make_scorer():
        return lambda frame: frame.assign(score=frame["t"].str.len() / len(frame))[["i", "score"]]

    scored = K.score_texts(df.coalesce(1), make_scorer, "i int, score double", batch_rows=5).collect()
    assert {r.i: r.score for r in scored} == {i: i / 5 for i in range(10)}


def most_rows_of_a_part(spark, build):
    """Share of the rows that lies in the fullest partition, with the plan Spark makes without statistics."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("false", "-1")):
            spark.conf.set(name, value)
        counts = [r["count"] for r in build().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    return max(counts) / sum(counts)


def test_sample_of_one_group_stays_dealt_out(spark):
    rows = spark.range(4000).withColumn("g", F.lit("a"))
    assert most_rows_of_a_part(spark, lambda: M.sample_frac(rows, ["g"], F.col("id"), 0.9, 1)) < 0.5


def test_split_of_one_group_stays_dealt_out(spark):
    rows = spark.range(4000).withColumn("g", F.lit("a"))
    assert most_rows_of_a_part(spark, lambda: M.train_val_split(rows, ["g"], F.col("id"), 0.1, 3)) < 0.5


def test_split_moves_rows_without_their_hash(spark):
    rows = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 == 0, "a").otherwise("b")).unionAll(spark.range(5).withColumn("g", F.lit("c")))
    split = M.train_val_split(rows, ["g"], F.col("id"), 0.15, 3)
    ranks = {g: sorted((hashlib.md5(f"3:{r.id}".encode()).hexdigest(), str(r.id)) for r in rows.collect() if r.g == g) for g in "abc"}
    val = {(g, int(i)) for g, ids in ranks.items() for _, i in ids[:math.ceil(len(ids) * 0.15)]}
    assert {(r.g, r.id) for r in split.collect() if r.part == "val"} == val
    assert split.count() == rows.count()
    assert "_hash" not in split._jdf.queryExecution().optimizedPlan().toString()
