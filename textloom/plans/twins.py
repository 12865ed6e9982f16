"""SQL fragments shared by the DuckDB twins."""

from __future__ import annotations

import string

from textloom.functions.text import SENTENCE_MARKS, SPACE_CLASS, SPACES
from textloom.sources.dims import DIALECT_CLASSES


def strip(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{SPACE_CLASS}+', ' ', 'g')"


def words(x: str) -> str:
    return f"(CASE WHEN {collapse(x)} = '' THEN []::VARCHAR[] ELSE string_split({collapse(x)}, ' ') END)"


def bare_chars(x: str) -> str:
    bare = f"regexp_replace({x}, '{SPACE_CLASS}+', '', 'g')"
    return f"(CASE WHEN {bare} = '' THEN []::VARCHAR[] ELSE string_split({bare}, '') END)"


def sentences(x: str) -> str:
    pieces = f"regexp_split_to_array({collapse(x)}, '[{SENTENCE_MARKS}]+')"
    return f"list_filter(list_transform({pieces}, lambda s: trim(s)), lambda s: s <> '')"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def joined(array: str) -> str:
    return f"md5(array_to_string({array}, ','))"


def windows_of(source: str, keys: str, tokens: str, size: int, out: str) -> str:
    """CTE ``out(keys, t1..tn)``: each token with the ``size - 1`` that follow it."""
    leads = ", ".join(f"lead(t1, {k}) OVER w AS t{k + 1}" for k in range(1, size))
    return f"""
    {out}_u AS (SELECT {keys}, unnest({tokens}) AS t1, generate_subscripts({tokens}, 1) AS i FROM {source}),
    {out} AS (SELECT {keys}, t1, {leads} FROM {out}_u WINDOW w AS (PARTITION BY {keys} ORDER BY i))"""


def gram(n: int, glue: str) -> str:
    """Gram of order n over ``windows_of`` columns; null past the end."""
    return f" || '{glue}' || ".join(f"t{k}" for k in range(1, n + 1))


_MARKS = string.punctuation.replace("'", "''")


def chrf_words(x: str) -> str:
    """Words with one trailing, or else one leading, mark split off."""
    def is_mark(c: str) -> str:
        return f"contains('{_MARKS}', {c})"

    cut = f"""CASE WHEN length(w) > 1 AND {is_mark("w[-1:]")} THEN [w[:-2], w[-1:]]
                   WHEN length(w) > 1 AND {is_mark("w[1:1]")} THEN [w[1:1], w[2:]]
                   ELSE [w] END"""
    return f"flatten(list_transform({words(x)}, lambda w: {cut}))"


def gram_counts(source: str, keys: str, text: str, out: str) -> str:
    """CTEs that end in ``out(keys, ord, gram, n)``: chrF grams of a text column."""
    parts = [f"SELECT {keys}, {n} AS ord, {gram(n, '')} AS gram FROM {out}_cw" for n in range(1, 7)]
    parts += [f"SELECT {keys}, {6 + n} AS ord, {gram(n, ' ')} AS gram FROM {out}_ww" for n in (1, 2)]
    return f"""
    {out}_t AS (SELECT {keys}, {bare_chars(text)} AS cs, {chrf_words(text)} AS ws FROM {source}),
    {windows_of(out + '_t', keys, 'cs', 6, out + '_cw')},
    {windows_of(out + '_t', keys, 'ws', 2, out + '_ww')},
    {out} AS (SELECT {keys}, ord, gram, count(*) AS n FROM ({' UNION ALL '.join(parts)})
              WHERE gram IS NOT NULL GROUP BY ALL)"""


def chrf_from(stats: str, keys: str) -> str:
    """SELECT of ``keys, chrf`` in 0..1 from ``stats(keys, ord, h, r, m)``."""
    return f"""
    SELECT {keys}, CASE WHEN e > 0 AND p + r > 0 THEN 5 * (p / e) * (r / e) / (4 * (p / e) + r / e) ELSE 0.0 END::DOUBLE AS chrf
    FROM (SELECT {keys}, sum((h > 0 AND r > 0)::INT) AS e,
                 sum(CASE WHEN h > 0 AND r > 0 THEN m::DOUBLE / h ELSE 0 END) AS p,
                 sum(CASE WHEN h > 0 AND r > 0 THEN m::DOUBLE / r ELSE 0 END) AS r
          FROM {stats} GROUP BY {keys})"""


CLASS_VALUES = "(VALUES " + ", ".join(
    f"({i}, '{d}', '{c}', '{m}')" for i, (d, c, m) in enumerate(DIALECT_CLASSES)
) + ") AS dim(class_idx, dialect_name, country, macro)"

PAIRS = """
    pairs AS (
        SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion, s.text AS system
        FROM conversations u
        JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.role = 'system' AND s.turn = 0
        WHERE u.role = 'user')"""

RENDERED = PAIRS + f""",
    rendered AS (
        SELECT conv_id, turn, head || chr(10) || '<|assistant|>' || chr(10) AS prompt_text,
               head || chr(10) || '<|assistant|>' || chr(10) || {strip('completion')} || chr(10) AS full_text
        FROM (SELECT *, CASE WHEN coalesce(system, '') <> ''
                             THEN '<|system|>' || chr(10) || {strip('system')} || chr(10) ELSE '' END
                        || '<|user|>' || chr(10) || {strip('prompt')} AS head FROM pairs))"""

ENCODED = RENDERED + f""",
    toks AS (SELECT conv_id, turn, {words('full_text')} AS ws, len({words('prompt_text')}) AS prompt_len FROM rendered),
    flat AS (SELECT conv_id, turn, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM toks),
    vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM flat GROUP BY token),
    ids AS (SELECT conv_id, turn, list(id ORDER BY pos) AS full_ids FROM flat JOIN vocab USING (token) GROUP BY ALL),
    enc AS (SELECT conv_id, turn, prompt_len, full_ids FROM toks JOIN ids USING (conv_id, turn))"""

MASKED = ENCODED + """,
    cut AS (SELECT conv_id, turn, full_ids[1:128] AS input_ids, least(prompt_len, 128, len(full_ids)) AS c FROM enc),
    masked AS (SELECT conv_id, turn, input_ids, list_transform(input_ids, lambda x: 1) AS attention_mask,
                      list_concat(list_transform(range(0, c), lambda i: -100::BIGINT), input_ids[c + 1:]) AS labels
               FROM cut)"""

CANDIDATES = f"""
    base AS (
        SELECT 'run' || (conv_id % 4) || '_' || turn AS source, conv_id // 4 AS line_idx,
               (conv_id % 4) * 1000 + turn AS cand_idx,
               CASE WHEN (conv_id + turn) % 11 = 0 THEN ' ' ELSE text END AS completion
        FROM conversations WHERE role = 'assistant'),
    lines AS (
        SELECT * FROM base
        UNION ALL SELECT 'copy_' || source, line_idx, cand_idx + 10000, completion FROM base WHERE cand_idx < 1000
        UNION ALL SELECT 'wide_' || source, line_idx, cand_idx + 20000, replace(completion, ' ', '  ')
                  FROM base WHERE cand_idx < 1000),
    prompts AS (
        SELECT conv_id // 4 AS prompt_id, arg_min(text, (conv_id, turn)) AS prompt
        FROM conversations WHERE role = 'user' GROUP BY conv_id // 4),
    aligned AS (
        SELECT prompt_id, prompt, source, cand_idx, {strip('completion')} AS completion
        FROM prompts JOIN lines ON line_idx = prompt_id WHERE {strip('completion')} <> ''),
    cands AS (
        SELECT *, logp_sum / token_count AS score_used
        FROM (SELECT *, length(completion) / -100.0::DOUBLE AS logp_sum, len({words('completion')}) AS token_count
              FROM aligned))"""

EDITED = f"""
    edited AS (
        SELECT *, array_to_string(hyp_tokens, ' ') AS hyp
        FROM (SELECT doc_id, lang, text AS ref, ref_tokens,
                     list_filter(ref_tokens, lambda w, i: i % 3 <> 0) AS hyp_tokens
              FROM (SELECT *, {words('text')} AS ref_tokens FROM documents)))"""


def softmax_over(source: str, score: str, group: str, out: str) -> str:
    """SELECT that adds a max-shifted softmax of a score per group."""
    return f"""SELECT * EXCLUDE (_e, _m), CASE WHEN sum(_e) OVER g = 0 OR NOT isfinite(sum(_e) OVER g)
                          THEN 1.0::DOUBLE / count(*) OVER g ELSE _e / sum(_e) OVER g END AS {out}
               FROM (SELECT *, exp({score} - _m) AS _e
                     FROM (SELECT *, max({score}) OVER (PARTITION BY {group}) AS _m FROM {source}))
               WINDOW g AS (PARTITION BY {group})"""


def repetition(source: str, keys: str, text: str, out: str) -> str:
    """CTEs that end in ``out(keys, w4, c8, run, rep, loop)``."""
    hits = [
        f"CASE WHEN len(ss) >= {3 * p} THEN len(list_filter(range(0, len(ss)), lambda i: ss[i + 1] = ss[(i % {p}) + 1])) ELSE 0 END"
        for p in range(1, 7)
    ]

    def distinct_share(windows: str, n: int) -> str:
        return f"""SELECT {keys}, 1 - count(DISTINCT g)::DOUBLE / count(g) AS share, count(g) AS n
                   FROM (SELECT {keys}, {gram(n, chr(1))} AS g FROM {windows}) GROUP BY {keys}"""

    return f"""
    {out}_t AS (SELECT {keys}, {words(text)} AS ws,
                       CASE WHEN {strip(text)} = '' THEN []::VARCHAR[] ELSE string_split({strip(text)}, '') END AS cs,
                       {sentences(text)} AS ss FROM {source}),
    {windows_of(out + '_t', keys, 'ws', 4, out + '_ww')},
    {windows_of(out + '_t', keys, 'cs', 8, out + '_cw')},
    {out}_w4 AS ({distinct_share(out + '_ww', 4)}),
    {out}_c8 AS ({distinct_share(out + '_cw', 8)}),
    {out}_r AS (SELECT {keys}, max(n) AS longest FROM (
                  SELECT {keys}, ch, g, count(*) AS n FROM (
                    SELECT {keys}, t1 AS ch, i - row_number() OVER (PARTITION BY {keys}, t1 ORDER BY i) AS g
                    FROM {out}_cw_u) GROUP BY ALL) GROUP BY {keys}),
    {out}_s AS (SELECT {keys}, unnest(list_filter(ss, lambda s: length(s) >= 10)) AS s FROM {out}_t),
    {out}_k AS (SELECT {keys}, CASE WHEN sum(n) <= 1 THEN 0 ELSE
                  greatest(sum(CASE WHEN n >= 2 THEN n ELSE 0 END), max(n))::DOUBLE / sum(n) END AS rep
                FROM (SELECT {keys}, s, count(*) AS n FROM {out}_s GROUP BY ALL) GROUP BY {keys}),
    {out} AS (SELECT {keys},
                CASE WHEN w.n > 4 THEN w.share ELSE 0.0::DOUBLE END AS w4,
                CASE WHEN c.n > 8 THEN c.share ELSE 0.0::DOUBLE END AS c8,
                1 - exp(-greatest(0, coalesce(longest, 0) - 3) / 8.0::DOUBLE) AS run,
                coalesce(rep, 0.0::DOUBLE) AS rep,
                CASE WHEN len(ss) < 6 THEN 0.0::DOUBLE ELSE
                  greatest(0, least(1, (greatest({', '.join(hits)})::DOUBLE / len(ss) - 0.6::DOUBLE) / 0.4::DOUBLE)) END AS loop
              FROM {out}_t LEFT JOIN {out}_w4 w USING ({keys}) LEFT JOIN {out}_c8 c USING ({keys})
              LEFT JOIN {out}_r USING ({keys}) LEFT JOIN {out}_k USING ({keys}))"""
