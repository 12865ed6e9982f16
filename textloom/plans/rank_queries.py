"""Queries over candidates: alignment, posterior, chrF risk, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.arrays import length_norm_score, masked_logprob
from textloom.functions.ngrams import chrf_matrix
from textloom.operators import candidates as C
from textloom.operators import mbr
from textloom.operators.mbr_bounds import best_by_bounds
from textloom.plans import twins as T
from textloom.plans.fixtures import (
    candidate_lines, candidates, encoded_pairs, prompts, r6,
)
from textloom.plans.registry import query
from textloom.session import durable
from textloom.sources.writers import ranked_rows

_POSTERIOR = f"post AS ({T.softmax_over('cands', 'score_used', 'prompt_id', 'p_model')})"

_RISK = f"""
    texts AS (SELECT prompt_id, completion, sum(p_model) AS mass, min(cand_idx) AS text_id
              FROM post GROUP BY prompt_id, completion),
    {T.gram_counts('texts', 'prompt_id, text_id', 'completion', 'g')},
    ords AS (SELECT unnest(range(1, 9)) AS ord),
    tot AS (SELECT prompt_id, text_id, ord, sum(n) AS total FROM g GROUP BY ALL),
    hits AS (SELECT a.prompt_id, a.text_id AS i, b.text_id AS j, a.ord, sum(least(a.n, b.n)) AS m
             FROM g a JOIN g b ON a.prompt_id = b.prompt_id AND a.ord = b.ord AND a.gram = b.gram GROUP BY ALL),
    stats AS (SELECT a.prompt_id, a.text_id AS i, b.text_id AS j, ords.ord,
                     coalesce(th.total, 0) AS h, coalesce(tr.total, 0) AS r, coalesce(m, 0) AS m
              FROM texts a JOIN texts b ON a.prompt_id = b.prompt_id CROSS JOIN ords
              LEFT JOIN tot th ON th.prompt_id = a.prompt_id AND th.text_id = a.text_id AND th.ord = ords.ord
              LEFT JOIN tot tr ON tr.prompt_id = a.prompt_id AND tr.text_id = b.text_id AND tr.ord = ords.ord
              LEFT JOIN hits x ON x.prompt_id = a.prompt_id AND x.i = a.text_id AND x.j = b.text_id AND x.ord = ords.ord),
    sims AS ({T.chrf_from('stats', 'prompt_id, i, j')}),
    risks AS (SELECT s.prompt_id, t.completion, sum(o.mass * (1 - chrf)) AS risk
              FROM sims s JOIN texts t ON t.prompt_id = s.prompt_id AND t.text_id = s.i
              JOIN texts o ON o.prompt_id = s.prompt_id AND o.text_id = s.j GROUP BY ALL),
    risked AS (SELECT post.*, risk FROM post JOIN risks USING (prompt_id, completion))"""

def _significant(value: str) -> str:
    scale = f"pow(10.0::DOUBLE, 11 - greatest(floor(log10(abs({value}))), -280))"
    return f"CASE WHEN {value} = 0 OR NOT isfinite({value}) THEN {value} ELSE round({value} * {scale}) / {scale} END"


def _final(risk_temperature: float = 1.0) -> str:
    return f"""
    {T.repetition('texts', 'prompt_id, text_id', 'completion', 'reps')},
    pen AS (SELECT risked.*, greatest(w4, c8, run) AS word_rep_penalty, greatest(rep, loop) AS sent_rep_penalty
            FROM risked JOIN texts USING (prompt_id, completion) JOIN reps USING (prompt_id, text_id)),
    fin AS (SELECT *, risk + 0.1::DOUBLE * (word_rep_penalty + sent_rep_penalty) AS risk_final FROM pen),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {_significant('risk_final')},
                                            {_significant('score_used')} DESC, cand_idx) AS rank_by_risk
               FROM ({T.softmax_over('fin', f'(-risk_final / {risk_temperature}::DOUBLE)', 'prompt_id', 'p_risk')}))"""


_FINAL = _final()


@query("align_candidates", f"""
    WITH {T.CANDIDATES}
    SELECT prompt_id, source, cand_idx, md5(prompt) AS prompt_digest, md5(completion) AS digest FROM aligned""")
def align_candidates(spark, sf_dir):
    aligned = C.align_candidates(prompts(spark, sf_dir), candidate_lines(spark, sf_dir))
    return aligned.select(
        "prompt_id", "source", "cand_idx", F.md5("prompt").alias("prompt_digest"), F.md5("completion").alias("digest")
    )


@query("strict_parallel", f"""
    WITH {T.CANDIDATES}
    SELECT source, max(line_idx) + 1 AS n_lines, (SELECT count(*) FROM prompts) AS n_prompts
    FROM lines GROUP BY source HAVING max(line_idx) + 1 < (SELECT count(*) FROM prompts)""")
def strict_parallel(spark, sf_dir):
    return C.short_sources(candidate_lines(spark, sf_dir), prompts(spark, sf_dir).count())


@query("dedupe_candidates", f"""
    WITH {T.CANDIDATES}
    SELECT prompt_id, cand_idx, source, md5(completion) AS digest
    FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, {T.collapse('completion')} ORDER BY cand_idx) AS rn FROM aligned)
    WHERE rn = 1""")
def dedupe_candidates(spark, sf_dir):
    aligned = C.align_candidates(prompts(spark, sf_dir), candidate_lines(spark, sf_dir))
    return C.dedupe_candidates(aligned).select("prompt_id", "cand_idx", "source", F.md5("completion").alias("digest"))


@query("candidate_softmax", f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}
    SELECT prompt_id, cand_idx, {T.r6('p_model')} AS p_model FROM post""")
def candidate_softmax(spark, sf_dir):
    return C.candidate_softmax(candidates(spark, sf_dir)).select("prompt_id", "cand_idx", r6("p_model").alias("p_model"))


@query("masked_logprob", f"""
    WITH {T.ENCODED}
    SELECT conv_id, turn, {T.r6('coalesce(list_sum(lp), 0)')} AS logp_sum, len(lp)::BIGINT AS token_count
    FROM (SELECT conv_id, turn, list_transform(full_ids[prompt_len + 1:], lambda x: -x / 1000.0::DOUBLE) AS lp FROM enc)""")
def masked_logprobs(spark, sf_dir):
    logp = F.transform("full_ids", lambda x: -x / F.lit(1000.0))
    total, count = masked_logprob(logp, F.col("prompt_len"))
    return encoded_pairs(spark, sf_dir).select(
        "conv_id", "turn", r6(total).alias("logp_sum"), count.alias("token_count")
    )


@query("length_norm_score", f"""
    WITH {T.ENCODED}
    SELECT conv_id, turn, CASE WHEN n > 0 THEN {T.r6('s / n')} ELSE '-inf'::DOUBLE END AS score_used
    FROM (SELECT conv_id, turn, len(lp) AS n, list_sum(lp) AS s
          FROM (SELECT conv_id, turn, list_transform(full_ids[(CASE WHEN turn % 3 = 0 THEN prompt_len ELSE 100000 END) + 1:],
                       lambda x: -x / 1000.0::DOUBLE) AS lp FROM enc))""")
def length_norm_scores(spark, sf_dir):
    logp = F.transform("full_ids", lambda x: -x / F.lit(1000.0))
    prompt_len = F.when(F.col("turn") % 3 == 0, F.col("prompt_len")).otherwise(100_000)
    total, count = masked_logprob(logp, prompt_len)
    scored = encoded_pairs(spark, sf_dir).select("conv_id", "turn", total.alias("s"), count.alias("n"))
    score = length_norm_score(F.col("s"), F.col("n"))
    return scored.select(
        "conv_id", "turn", F.when(F.col("n") > 0, r6(score)).otherwise(score).alias("score_used")
    )


@query("mbr_expected_risk", f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}, {_RISK}
    SELECT prompt_id, cand_idx, {T.r6('risk')} AS risk FROM risked""")
def mbr_expected_risk(spark, sf_dir):
    risked = mbr.expected_risk(C.candidate_softmax(candidates(spark, sf_dir)))
    return risked.select("prompt_id", "cand_idx", r6("risk").alias("risk"))


@query("mbr_expected_risk_blocks", f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}, {_RISK}
    SELECT prompt_id, cand_idx, {T.r6('risk')} AS risk FROM risked""")
def mbr_expected_risk_blocks(spark, sf_dir):
    """The same risks with prompts cut into blocks of about three texts."""
    risked = mbr.expected_risk(C.candidate_softmax(candidates(spark, sf_dir)), chrf_matrix, block_texts=3)
    return risked.select("prompt_id", "cand_idx", r6("risk").alias("risk"))


@query("mbr_final_risk", f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}, {_RISK}, {_FINAL}
    SELECT prompt_id, cand_idx, {T.r6('risk_final')} AS risk_final, {T.r6('p_risk')} AS p_risk FROM ranked""")
def mbr_final_risk(spark, sf_dir):
    return mbr.score_candidates(candidates(spark, sf_dir)).select(
        "prompt_id", "cand_idx", r6("risk_final").alias("risk_final"), r6("p_risk").alias("p_risk")
    )


@query("mbr_rank", f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}, {_RISK}, {_FINAL}
    SELECT prompt_id, rank_by_risk, cand_idx, source, {T.r6('p_risk')} AS p_risk, {T.r6('risk')} AS risk FROM ranked""")
def mbr_rank(spark, sf_dir):
    aligned = durable(candidates(spark, sf_dir))
    ranked = mbr.rank_by_risk(aligned, mbr.score_candidates(aligned))
    return ranked.select(
        "prompt_id", "rank_by_risk", "cand_idx", "source", r6("p_risk").alias("p_risk"), r6("risk").alias("risk")
    )


@query("mbr_rank_cold", f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}, {_RISK}, {_final(0.01)}
    SELECT prompt_id, rank_by_risk, cand_idx, {T.r6('p_risk')} AS p_risk FROM ranked""")
def mbr_rank_cold(spark, sf_dir):
    """Ranks at a risk temperature where most probabilities vanish."""
    aligned = durable(candidates(spark, sf_dir))
    ranked = mbr.rank_by_risk(aligned, mbr.score_candidates(aligned, risk_temperature=0.01))
    return ranked.select("prompt_id", "rank_by_risk", "cand_idx", r6("p_risk").alias("p_risk"))


_BEST = f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}, {_RISK}, {_FINAL}
    SELECT prompt_id, cand_idx, completion, {T.r6('risk_final')} AS risk_final FROM ranked WHERE rank_by_risk = 1"""


@query("mbr_best", _BEST)
def mbr_best(spark, sf_dir):
    best, _ = best_by_bounds(candidates(spark, sf_dir))
    return best.select("prompt_id", "cand_idx", "completion", r6("risk_final").alias("risk_final"))


@query("mbr_best_rounds", _BEST)
def mbr_best_rounds(spark, sf_dir):
    """The same candidates, found in rounds of two references and more."""
    best, _ = best_by_bounds(candidates(spark, sf_dir), block_texts=2)
    return best.select("prompt_id", "cand_idx", "completion", r6("risk_final").alias("risk_final"))


@query("mbr_csv_rows", f"""
    WITH {T.CANDIDATES}, {_POSTERIOR}, {_RISK}, {_FINAL}
    SELECT prompt_id, rank_by_risk, md5(prompt) AS prompt, md5(completion) AS completion, token_count,
           printf('%.8f', logp_sum) AS logp_sum, printf('%.8f', score_used) AS score_used,
           printf('%.8f', p_model) AS p_model, printf('%.8f', risk) AS risk_1_minus_chrf,
           printf('%.8f', p_risk) AS p_risk, source,
           {T.r6('sent_rep_penalty')} AS sent_rep_penalty, {T.r6('word_rep_penalty')} AS word_rep_penalty
    FROM ranked""")
def mbr_csv_rows(spark, sf_dir):
    aligned = durable(candidates(spark, sf_dir))
    ranked = mbr.rank_by_risk(aligned, mbr.score_candidates(aligned))
    return ranked_rows(ranked).withColumns({
        "prompt": F.md5("prompt"), "completion": F.md5("completion"),
        "sent_rep_penalty": r6("sent_rep_penalty"), "word_rep_penalty": r6("word_rep_penalty"),
    })
