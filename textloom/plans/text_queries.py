"""Queries over single texts: cleaning, formats, sentences, repetition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import chat, repetition, text
from textloom.functions.templates import UserTemplate
from textloom.operators.long_texts import with_repetition_of_any_length
from textloom.operators.reports import unfinished
from textloom.plans import twins as T
from textloom.plans.fixtures import documents, prompt_pairs, r6, rendered_pairs, table
from textloom.plans.registry import query
from textloom.sources.readers import dataset_name_fields, line_text, nonempty_pairs, run_path_fields

_RAW_SQL = """(SELECT doc_id, lang, CASE doc_id % 6
        WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN chr(9) || text || chr(12288) || chr(28)
        WHEN 3 THEN '  ' ELSE text END AS raw FROM documents)"""


def _raw(spark, sf_dir):
    kind, body = F.col("doc_id") % 6, F.col("text")
    raw = (
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(" NaN "))
        .when(kind == 2, F.concat(F.lit("\t"), body, F.lit("　\x1c")))
        .when(kind == 3, F.lit("  ")).otherwise(body)
    )
    return table(spark, sf_dir, "documents").select("doc_id", "lang", raw.alias("raw"))


def _digest(x: Column) -> list[Column]:
    return [F.length(x).cast("bigint").alias("n_chars"), F.md5(x).alias("digest")]


_NORMAL = f"CASE WHEN lower({T.strip('raw')}) = 'nan' THEN '' ELSE coalesce({T.strip('raw')}, '') END"


@query("normalize_text", f"""
    SELECT doc_id, length(t) AS n_chars, md5(t) AS digest
    FROM (SELECT doc_id, {_NORMAL} AS t FROM {_RAW_SQL})""")
def normalize_text(spark, sf_dir):
    return _raw(spark, sf_dir).select("doc_id", text.normalize_text(F.col("raw")).alias("t")).select(
        "doc_id", *_digest(F.col("t"))
    )


@query("clean_text", f"""
    SELECT doc_id, length(t) AS n_chars, md5(t) AS digest
    FROM (SELECT doc_id, {T.strip("replace(coalesce(raw, ''), chr(10), ' ')")} AS t FROM {_RAW_SQL})""")
def clean_text(spark, sf_dir):
    return _raw(spark, sf_dir).select("doc_id", text.clean_text(F.col("raw")).alias("t")).select(
        "doc_id", *_digest(F.col("t"))
    )


@query("filter_nonempty_pairs", f"""
    SELECT doc_id, md5(prompt) AS prompt_digest, md5(completion) AS completion_digest
    FROM (SELECT doc_id, {_NORMAL} AS prompt, {_NORMAL.replace('raw', 'lang')} AS completion FROM {_RAW_SQL})
    WHERE prompt <> '' AND completion <> ''""")
def filter_nonempty_pairs(spark, sf_dir):
    pairs = _raw(spark, sf_dir).select(
        "doc_id", text.normalize_text(F.col("raw")).alias("prompt"),
        text.normalize_text(F.col("lang")).alias("completion"),
    )
    return nonempty_pairs(pairs).select(
        "doc_id", F.md5("prompt").alias("prompt_digest"), F.md5("completion").alias("completion_digest")
    )


@query("coalesce_fields", """
    SELECT doc_id, coalesce(nullif(a, ''), nullif(b, ''), 'English') AS source_lang,
           coalesce(nullif(c, ''), 'French') AS target_lang
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS a,
                 CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS b,
                 CASE WHEN doc_id % 5 = 0 THEN lang END AS c FROM documents)""")
def coalesce_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    b = F.when(F.col("doc_id") % 2 != 0, F.col("source"))
    c = F.when(F.col("doc_id") % 5 == 0, F.col("lang"))
    return docs.select(
        "doc_id", text.first_nonempty(a, b, default="English").alias("source_lang"),
        text.first_nonempty(c, default="French").alias("target_lang"),
    )


_TARGET = "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END"
_LF = "chr(10)"


def _format_query(render):
    def run(spark, sf_dir):
        target = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
        out = render(F.col("lang"), F.lit("Arabic"), F.col("text"), target)
        return table(spark, sf_dir, "documents").select("doc_id", out.alias("t")).select("doc_id", *_digest(F.col("t")))

    return run


def _format_sql(expression: str) -> str:
    return f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {expression} AS t FROM documents)"


query("fmt_translation_plain", _format_sql(
    f"'Translate the following text from ' || lang || ' to Arabic.' || {_LF} || {_LF} || lang || ':' || {_LF}"
    f" || text || {_LF} || {_LF} || 'Arabic:' || {_LF} || {_TARGET}"
))(_format_query(chat.translation_plain))

query("fmt_translation_chat", _format_sql(
    f"'<|begin_of_text|>' || {_LF} || '<|user|>' || {_LF} || 'Translate the following text from ' || lang"
    f" || ' to Arabic.' || {_LF} || {_LF} || lang || ':' || {_LF} || text || {_LF} || '<|assistant|>' || {_LF} || {_TARGET}"
))(_format_query(chat.translation_chat))


@query("render_chat", f"""
    WITH {T.RENDERED}
    SELECT conv_id, turn, md5(full_text) AS full_digest, md5(prompt_text) AS prompt_digest,
           length(full_text) AS n_chars FROM rendered""")
def render_chat(spark, sf_dir):
    return rendered_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.md5("full_text").alias("full_digest"), F.md5("prompt_text").alias("prompt_digest"),
        F.length("full_text").cast("bigint").alias("n_chars"),
    )


_CHATML = (
    "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}"
    "{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)


def _chatml_sql(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


@query("render_user_template", f"""
    WITH {T.PAIRS},
    heads AS (SELECT *, CASE WHEN coalesce(system, '') <> '' THEN {_chatml_sql('system', 'system')} ELSE '' END
                        || {_chatml_sql('user', 'prompt')} AS head FROM pairs)
    SELECT conv_id, turn, md5(head || {_chatml_sql('assistant', 'completion')}) AS full_digest,
           md5(head || '<|im_start|>assistant' || chr(10)) AS prompt_digest FROM heads""")
def render_user_template(spark, sf_dir):
    """The pairs by a template as users write them."""
    full, head = chat.render_pair(F.col("prompt"), F.col("completion"), F.col("system"), UserTemplate(_CHATML))
    return prompt_pairs(spark, sf_dir).select("conv_id", "turn", F.md5(full).alias("full_digest"), F.md5(head).alias("prompt_digest"))


@query("fmt_instruction", f"""
    WITH {T.PAIRS}
    SELECT conv_id, turn, md5(head || completion) AS full_digest, md5(head) AS prompt_digest
    FROM (SELECT *, '### Instruction:' || chr(10) || prompt || chr(10) || chr(10)
                    || '### Response:' || chr(10) AS head FROM pairs)""")
def fmt_instruction(spark, sf_dir):
    full, head = chat.instruction_pair(F.col("prompt"), F.col("completion"))
    return prompt_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.md5(full).alias("full_digest"), F.md5(head).alias("prompt_digest")
    )


@query("split_sentences", f"""
    SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(10))) AS digest
    FROM (SELECT doc_id, {T.sentences('text')} AS s FROM documents)""")
def split_sentences(spark, sf_dir):
    split = documents(spark, sf_dir).select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    return split.select(
        "doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest")
    )


def _repetition_sql(column: str, expression: str) -> str:
    return f"WITH {T.repetition('documents', 'doc_id', 'text', 'reps')} SELECT doc_id, {T.r6(expression)} AS {column} FROM reps"


def _penalty(name: str, column: str, expression: str, build) -> None:
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir).select("doc_id", "text", text.split_sentences(F.col("text")).alias("s"))
        return docs.select("doc_id", r6(build(F.col("text"), F.col("s"))).alias(column))

    query(name, _repetition_sql(column, expression))(run)


_penalty("rep_word4_penalty", "penalty", "w4", lambda t, s: repetition.rep_ngram_penalty(t, 4, "word"))
_penalty("rep_char8_penalty", "penalty", "c8", lambda t, s: repetition.rep_ngram_penalty(t, 8, "char"))
_penalty("max_run_penalty", "penalty", "run", lambda t, s: repetition.max_run_penalty(t, "char"))
_penalty("repeated_sentence_penalty", "penalty", "rep", lambda t, s: repetition.repeated_sentence_penalty(s))
_penalty("looping_penalty", "penalty", "loop", lambda t, s: repetition.looping_penalty(s))
_penalty("sentence_repetition", "penalty", "greatest(rep, loop)", lambda t, s: repetition.sentence_repetition(s))
_penalty("word_repetition", "penalty", "greatest(w4, c8, run)", lambda t, s: repetition.word_repetition(t))


@query("repetition_in_pieces", f"""
    WITH {T.repetition('documents', 'doc_id', 'text', 'reps')}
    SELECT doc_id, {T.r6('greatest(w4, c8, run)')} AS word_rep_penalty, {T.r6('greatest(rep, loop)')} AS sent_rep_penalty FROM reps""")
def repetition_in_pieces(spark, sf_dir):
    """The penalties of documents, those of over 30,000 characters counted in pieces."""
    scored = with_repetition_of_any_length(documents(spark, sf_dir), ["doc_id"], "text", long_chars=30_000)
    return scored.select("doc_id", r6("word_rep_penalty").alias("word_rep_penalty"), r6("sent_rep_penalty").alias("sent_rep_penalty"))


@query("repetition_by_lang", f"""
    WITH {T.repetition('documents', 'doc_id', 'text', 'reps')}
    SELECT lang, {T.r6('avg(greatest(w4, c8, run))')} AS word_rep_penalty,
           {T.r6('avg(greatest(rep, loop))')} AS sent_rep_penalty, count(*) AS n
    FROM reps JOIN documents USING (doc_id) GROUP BY lang""")
def repetition_by_lang(spark, sf_dir):
    scored = repetition.with_repetition(documents(spark, sf_dir), "text")
    return scored.groupBy("lang").agg(
        r6(F.avg("word_rep_penalty")).alias("word_rep_penalty"),
        r6(F.avg("sent_rep_penalty")).alias("sent_rep_penalty"), F.count(F.lit(1)).alias("n"),
    )


@query("lid_code", """
    SELECT doc_id, CASE WHEN starts_with(label, '__label__') THEN label[10:12] ELSE label END AS code
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang ELSE '__label__' || lang || 'x_Latn' END AS label FROM documents)""")
def lid_code(spark, sf_dir):
    label = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(
        F.concat(F.lit("__label__"), F.col("lang"), F.lit("x_Latn"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.lid_code(label).alias("code"))


@query("escape_lines", """
    SELECT doc_id, length(t) AS n_chars, md5(t) AS digest
    FROM (SELECT doc_id, replace(text, chr(10), chr(92) || 'n') AS t FROM documents)""")
def escape_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.escape_newlines(F.col("text")).alias("t")
    ).select("doc_id", *_digest(F.col("t")))


_LINES_SQL = """(SELECT conv_id, turn, text, CASE (conv_id + turn) % 6
        WHEN 0 THEN text
        WHEN 1 THEN '{"output": ' || to_json(text) || ', "completion": 5}'
        WHEN 2 THEN '{"completion": "", "text": ' || to_json(text) || '}'
        WHEN 3 THEN '{broken ' || turn || '}'
        WHEN 4 THEN ' {"other": "x"} '
        ELSE '  ' END AS line FROM conversations)"""


@query("read_parallel_lines", f"""
    SELECT conv_id, turn, md5(CASE (conv_id + turn) % 6
        WHEN 0 THEN {T.strip('text')} WHEN 1 THEN {T.strip('text')}
        WHEN 3 THEN line ELSE '' END) AS digest FROM {_LINES_SQL}""")
def read_parallel_lines(spark, sf_dir):
    kind = (F.col("conv_id") + F.col("turn")) % 6
    body = F.col("text")
    as_json = F.to_json(F.struct(body.alias("output"), F.lit(5).alias("completion")))
    empty_first = F.to_json(F.struct(F.lit("").alias("completion"), body.alias("text")))
    line = (
        F.when(kind == 0, body).when(kind == 1, as_json).when(kind == 2, empty_first)
        .when(kind == 3, F.concat(F.lit("{broken "), F.col("turn"), F.lit("}")))
        .when(kind == 4, F.lit(' {"other": "x"} ')).otherwise("  ")
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(line_text(line)).alias("digest")
    )


@query("parse_dataset_name", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'bi' ELSE '' END AS kind,
           CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS corpus,
           CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'eng' END AS source_lang, lang AS target_lang
    FROM documents""")
def parse_dataset_name(spark, sf_dir):
    even, single = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    sep = F.when(even, "_").otherwise("-")
    pair = F.when(single, F.col("lang")).otherwise(F.concat(F.lit("eng"), sep, F.col("lang")))
    name = F.when(even, F.concat(F.lit("bi__"), F.col("source"), F.lit("__"), pair)).otherwise(
        F.concat(pair, F.lit(".csv"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", *dataset_name_fields(name))


@query("parse_run_path", """
    SELECT doc_id, 'base' || (doc_id % 3) AS base, (doc_id % 5 + 1) / 10.0::DOUBLE AS top_p,
           (doc_id % 4 + 5) / 10.0::DOUBLE AS temperature, 'fidelity' AS method, 'mono' AS lang_set,
           source AS corpus, lang AS dialect FROM documents WHERE doc_id % 7 <> 0
    UNION ALL SELECT doc_id, '', NULL, NULL, '', '', '', '' FROM documents WHERE doc_id % 7 = 0""")
def parse_run_path(spark, sf_dir):
    path = F.format_string(
        "file:/out/base%d_0.%d_0.%d/fidelity/mono/%s/%s.out",
        F.col("doc_id") % 3, F.col("doc_id") % 5 + 1, F.col("doc_id") % 4 + 5, F.col("source"), F.col("lang"),
    )
    odd = F.when(F.col("doc_id") % 7 == 0, F.lit("file:/out/base_x_y/m/s/c/d.out")).otherwise(path)
    return table(spark, sf_dir, "documents").select("doc_id", *run_path_fields(odd))


@query("incremental_todo", """
    SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_todo(spark, sf_dir):
    work = table(spark, sf_dir, "documents").select("doc_id", "source")
    return unfinished(work, table(spark, sf_dir, "labels"), ["doc_id"])
