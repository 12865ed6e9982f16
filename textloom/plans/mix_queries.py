"""Queries over token rows: masking, mixing, sampling, packing, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import arrays
from textloom.functions.text import words
from textloom.operators import mixing as M
from textloom.operators.slices import first_n, number_rows
from textloom.operators.tokens import build_vocabulary, label_coverage, training_row
from textloom.plans import twins as T
from textloom.plans.fixtures import MAX_LENGTH, encoded_pairs, joined, prompt_pairs, r6, rendered_pairs, table
from textloom.plans.registry import query

SEED = 13


def masked_rows(spark, sf_dir):
    encoded = encoded_pairs(spark, sf_dir)
    return encoded.select("conv_id", "turn", *training_row(F.col("full_ids"), F.col("prompt_len"), MAX_LENGTH))


@query("vocabulary", f"""
    WITH {T.ENCODED}
    SELECT token, count(*) AS freq, any_value(id) AS id FROM flat JOIN vocab USING (token) GROUP BY token""")
def vocabulary(spark, sf_dir):
    texts = rendered_pairs(spark, sf_dir).select(words(F.col("full_text")).alias("tokens"))
    return build_vocabulary(texts, "tokens")


@query("encode_tokens", f"""
    WITH {T.ENCODED} SELECT conv_id, turn, len(full_ids)::BIGINT AS n_ids, {T.joined('full_ids')} AS digest FROM enc""")
def encode_tokens(spark, sf_dir):
    return encoded_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.size("full_ids").cast("bigint").alias("n_ids"), joined("full_ids").alias("digest")
    )


@query("mask_labels", f"""
    WITH {T.MASKED}
    SELECT conv_id, turn, len(input_ids)::BIGINT AS n_ids, {T.joined('labels')} AS digest,
           len(list_filter(labels, lambda x: x <> -100))::BIGINT AS n_supervised FROM masked""")
def mask_labels(spark, sf_dir):
    return masked_rows(spark, sf_dir).select(
        "conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_ids"), joined("labels").alias("digest"), "n_supervised"
    )


_CUT_SQL = "coalesce(list_position(list_transform(labels, lambda x: x <> -100), true) - 1, len(labels))"


@query("split_at_mask", f"""
    WITH {T.MASKED}
    SELECT conv_id, turn, {T.joined(f'input_ids[1:{_CUT_SQL}]')} AS prompt_digest,
           {T.joined('list_filter(labels, lambda x: x <> -100)')} AS ref_digest FROM masked""")
def split_at_mask(spark, sf_dir):
    prompt, ref = arrays.split_at_mask(F.col("input_ids"), F.col("labels"))
    return masked_rows(spark, sf_dir).select(
        "conv_id", "turn", joined(prompt).alias("prompt_digest"), joined(ref).alias("ref_digest")
    )


@query("ensure_suffix", f"""
    WITH {T.MASKED}
    SELECT conv_id, turn, {T.joined('CASE WHEN ids[-2:] = tail THEN ids ELSE list_concat(ids, tail) END')} AS digest
    FROM (SELECT conv_id, turn, [1::BIGINT, 0::BIGINT] AS tail,
                 CASE WHEN conv_id % 2 = 0 THEN list_concat(input_ids, [1::BIGINT, 0::BIGINT]) ELSE input_ids END AS ids FROM masked)""")
def ensure_suffix(spark, sf_dir):
    tail = F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))
    ids = F.when(F.col("conv_id") % 2 == 0, F.concat("input_ids", tail)).otherwise(F.col("input_ids"))
    rows = masked_rows(spark, sf_dir).select("conv_id", "turn", ids.alias("ids"))
    return rows.select("conv_id", "turn", joined(arrays.ensure_suffix(F.col("ids"), [1, 0])).alias("digest"))


@query("label_coverage", f"""
    WITH {T.MASKED}
    SELECT {T.r6('avg(len(list_filter(labels, lambda x: x <> -100))::DOUBLE / greatest(1, len(labels)))')} AS coverage, count(*) AS n
    FROM (SELECT * FROM masked ORDER BY conv_id, turn LIMIT 50)""")
def label_coverages(spark, sf_dir):
    coverage = label_coverage(masked_rows(spark, sf_dir), "labels", [F.col("conv_id"), F.col("turn")], 50)
    return coverage.select(r6("coverage").alias("coverage"), "n")


@query("mix_train", f"""
    WITH {T.PAIRS} SELECT 'set' || (conv_id % 3) AS name, count(*) AS n, sum(length(completion))::BIGINT AS n_chars
    FROM pairs GROUP BY name""")
def mix_train(spark, sf_dir):
    pairs = prompt_pairs(spark, sf_dir)
    parts = [
        pairs.where(F.col("conv_id") % 3 == i).select(F.lit(f"set{i}").alias("name"), "conv_id", "turn", "completion")
        for i in range(3)
    ]
    return M.concat_parts(parts).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("completion")).alias("n_chars")
    )


@query("repeat_rows", """
    SELECT l_orderkey, l_linenumber, copy FROM (
        SELECT l_orderkey, l_linenumber, unnest(range(1, greatest(1, l_orderkey % 4) + 1)) AS copy FROM lineitem)""")
def repeat_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return M.repeat_rows(rows, F.col("l_orderkey") % 4)


@query("first_n", """
    SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5""")
def first_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return first_n(docs, ["source"], [F.asc("doc_id")], 5)


def _hash_rank_sql(group: str, key: str, seed: int) -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}:' || {key}), {key})"


_LINE_KEY = "l_orderkey || '-' || l_linenumber"


def _line_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return rows, F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))


@query("sample_frac", f"""
    SELECT l_returnflag, l_orderkey, l_linenumber
    FROM (SELECT *, {_hash_rank_sql('l_returnflag', _LINE_KEY, SEED)} AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    WHERE rn <= greatest(1, round_even(n * 0.05::DOUBLE, 0))""")
def sample_frac(spark, sf_dir):
    rows, key = _line_rows(spark, sf_dir)
    return M.sample_frac(rows, ["l_returnflag"], key, 0.05, SEED)


@query("seeded_shuffle", f"""
    SELECT l_orderkey, l_linenumber, {_hash_rank_sql('', _LINE_KEY, SEED)} AS pos FROM lineitem""")
def seeded_shuffle(spark, sf_dir):
    rows, key = _line_rows(spark, sf_dir)
    return M.seeded_shuffle(rows, key, SEED).select("l_orderkey", "l_linenumber", "pos")


@query("train_val_split", f"""
    SELECT l_returnflag, l_orderkey, l_linenumber, CASE WHEN rn <= ceil(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS part
    FROM (SELECT *, {_hash_rank_sql('l_returnflag', _LINE_KEY, SEED)} AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)""")
def train_val_split(spark, sf_dir):
    rows, key = _line_rows(spark, sf_dir)
    return M.train_val_split(rows, ["l_returnflag"], key, 0.1, SEED)


# A plan with every feature: share and count splits, repeats, both samplings.
PLAN = [
    M.MixEntry("set0", repeat=2, val_ratio=0.1, metrics=["loss", "ChrFpp"], chrf_eval_n=5),
    M.MixEntry("set1", val_ratio=9, sample_n=4, metrics=["loss", "ppl"]),
    M.MixEntry("set2", role="eval", sample_frac=0.25),
    M.MixEntry("set3", role="eval", sample_n=7, metrics=["chrfpp"]),
    M.MixEntry("set4", repeat=3, val_ratio=0.2, sample_frac=0.5),
    M.MixEntry("set5"),
]


def _mixed(spark, sf_dir, leak_safe=True):
    pairs = prompt_pairs(spark, sf_dir).select(F.concat(F.lit("set"), F.col("conv_id") % 6).alias("name"), "conv_id", "turn")
    plan = M.plan_table(spark, PLAN)
    order = [F.col("conv_id"), F.col("turn")]
    return M.dataset_mix(pairs, plan, ["conv_id", "turn"], order, SEED, leak_safe), plan


def _opt(x, cast: str) -> str:
    return f"{'NULL' if x is None else x}::{cast}"


_PLAN_SQL = "(VALUES " + ", ".join(
    f"('{e.name}', '{e.role}', {e.repeat}, {_opt(e.sample_frac, 'DOUBLE')}, {_opt(e.sample_n, 'BIGINT')}, {e.val_ratio}::DOUBLE,"
    f" '{','.join(sorted(m.lower() for m in e.metrics))}', {64 if e.chrf_eval_n is None else e.chrf_eval_n})" for e in PLAN
) + ") AS plan(name, role, repeat, sample_frac, sample_n, val_ratio, metrics, chrf_eval_n)"


def _mix_sql(leak_safe: bool) -> str:
    early = "CASE WHEN role = 'eval' THEN repeat ELSE 1 END" if leak_safe else "repeat"
    late = "CASE WHEN part = 'train' THEN repeat ELSE 1 END" if leak_safe else "1"
    return f"""
    {T.PAIRS},
    planned AS (SELECT 'set' || (conv_id % 6) AS name, conv_id, turn FROM pairs),
    rows AS (SELECT p.*, plan.* EXCLUDE (name), unnest(range(1, {early} + 1)) AS copy0 FROM planned p JOIN {_PLAN_SQL} ON p.name = plan.name),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY
                   CASE WHEN role = 'train' OR (sample_n IS NULL AND sample_frac IS NOT NULL)
                        THEN md5('{SEED}:' || conv_id || ':' || turn || ':' || copy0) END, conv_id, turn, copy0) AS rn FROM rows),
    sized AS (SELECT *, CASE WHEN role = 'eval' THEN n WHEN val_ratio > 1 THEN floor(val_ratio) ELSE ceil(n * val_ratio) END AS n_eval FROM ranked),
    kept AS (SELECT *, CASE WHEN rn <= n_eval THEN 'eval' ELSE 'train' END AS part FROM sized
             WHERE rn > n_eval OR rn <= CASE WHEN sample_n IS NOT NULL THEN sample_n
                  WHEN sample_frac IS NOT NULL THEN greatest(1, round_even(n_eval * sample_frac, 0)) ELSE n_eval END),
    mixed AS (SELECT name, conv_id, turn, part, greatest(copy0, copy1)::INT AS copy, metrics, chrf_eval_n, role,
                     CASE WHEN part = 'train' THEN NULL WHEN role = 'train' THEN name || '_val' ELSE name END AS eval_group
              FROM (SELECT *, unnest(range(1, {late} + 1)) AS copy1 FROM kept))"""


@query("mix_unplanned", """
    WITH counts AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY source),
    planned AS (SELECT 'src' || unnest(range(0, 100)) AS name)
    SELECT coalesce(c.name, p.name) AS name, p.name IS NOT NULL AS planned, coalesce(n, 0) AS n
    FROM counts c FULL JOIN planned p ON c.name = p.name WHERE c.name IS NULL OR p.name IS NULL""")
def mix_unplanned(spark, sf_dir):
    """Sources of the documents against a plan for a hundred of them."""
    data = table(spark, sf_dir, "documents").withColumnRenamed("source", "name")
    return M.plan_gaps(data, M.plan_table(spark, [M.MixEntry(f"src{i}") for i in range(100)]))


@query("dataset_mix", f"""
    WITH {_mix_sql(True)} SELECT name, conv_id, turn, part, eval_group, copy FROM mixed""")
def dataset_mix(spark, sf_dir):
    return _mixed(spark, sf_dir)[0]


@query("dataset_mix_repeat_first", f"""
    WITH {_mix_sql(False)} SELECT name, conv_id, turn, part, eval_group, copy FROM mixed""")
def dataset_mix_repeat_first(spark, sf_dir):
    return _mixed(spark, sf_dir, leak_safe=False)[0]


@query("mix_summary", f"""
    WITH {_mix_sql(True)}
    SELECT name, role, part, eval_group, count(*) AS n, CASE WHEN part = 'eval' THEN metrics END AS metrics,
           CASE WHEN part = 'eval' THEN least(chrf_eval_n, count(*)) ELSE 0 END AS chrf_rows
    FROM mixed GROUP BY name, role, part, eval_group, metrics, chrf_eval_n""")
def mix_summary(spark, sf_dir):
    mixed, plan = _mixed(spark, sf_dir)
    return M.mix_summary(mixed, plan).fillna(0, ["chrf_rows"])


@query("pack_sequences", f"""
    WITH RECURSIVE {T.MASKED},
    numbered AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, input_ids, labels FROM masked),
    batched AS (SELECT row_id // 32 AS batch, row_number() OVER (PARTITION BY row_id // 32 ORDER BY row_id) AS pos,
                       row_id, input_ids, labels, len(input_ids) AS n FROM numbered WHERE len(input_ids) > 0),
    fold AS (SELECT batch, pos, n AS used, 0 AS bin FROM batched WHERE pos = 1
             UNION ALL
             SELECT b.batch, b.pos, CASE WHEN f.used + b.n > 200 THEN b.n ELSE f.used + b.n END,
                    CASE WHEN f.used + b.n > 200 THEN f.bin + 1 ELSE f.bin END
             FROM fold f JOIN batched b ON b.batch = f.batch AND b.pos = f.pos + 1)
    SELECT batch, bin, count(*) AS n_rows, {T.joined('flatten(list(input_ids ORDER BY pos))[1:200]')} AS ids_digest,
           {T.joined('flatten(list(labels ORDER BY pos))[1:200]')} AS labels_digest
    FROM fold JOIN batched USING (batch, pos) GROUP BY batch, bin""")
def pack_sequences(spark, sf_dir):
    masked, key = masked_rows(spark, sf_dir), ["conv_id", "turn"]
    numbers = number_rows(masked.select(*key), [], [F.asc(k) for k in key], "row_id")
    rows = masked.join(numbers.withColumn("row_id", F.col("row_id") - 1), key)
    return M.pack_sequences(rows, "row_id", 200, batch_rows=32).select(
        "batch", "bin", "n_rows", joined("input_ids").alias("ids_digest"), joined("labels").alias("labels_digest")
    )


@query("pad_batches", f"""
    WITH {T.MASKED},
    numbered AS (SELECT *, (row_number() OVER (ORDER BY len(input_ids), conv_id, turn) - 1) // 16 AS batch FROM masked),
    wide AS (SELECT *, (ceil(max(len(input_ids)) OVER (PARTITION BY batch) / 8.0::DOUBLE) * 8)::INT AS width FROM numbered)
    SELECT conv_id, turn, batch, width,
           {T.joined('list_concat(input_ids, list_transform(range(0, width - len(input_ids)), lambda i: 0::BIGINT))')} AS ids_digest,
           {T.joined('list_concat(attention_mask, list_transform(range(0, width - len(input_ids)), lambda i: 0))')} AS mask_digest,
           {T.joined('list_concat(labels, list_transform(range(0, width - len(input_ids)), lambda i: -100::BIGINT))')} AS labels_digest
    FROM wide""")
def pad_batches(spark, sf_dir):
    padded = M.pad_batches(masked_rows(spark, sf_dir), ["conv_id", "turn"], 16)
    return padded.select(
        "conv_id", "turn", "batch", "width", joined("input_ids").alias("ids_digest"),
        joined("attention_mask").alias("mask_digest"), joined("labels").alias("labels_digest"),
    )
