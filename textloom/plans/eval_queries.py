"""Queries over pairs and classifier outputs: chrF, BLEU, fidelity, reports."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from textloom.functions import arrays
from textloom.functions.text import lid_code
from textloom.operators import fidelity as D
from textloom.operators import overlap as O
from textloom.operators.reports import macro_score, mt_report
from textloom.operators.runlog import average_lengths
from textloom.operators.slices import number_rows
from textloom.operators.tokens import subword_tokens
from textloom.plans import twins as T
from textloom.plans.fixtures import edited_documents, r6, table
from textloom.plans.registry import query
from textloom.session import shared_folder
from textloom.sources import dims
from textloom.streaming import live

ALLOWED = {"eng": ["en", "de"], "rom": ["fr", "es"]}
_ALLOWED_SQL = "(VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in ALLOWED.items() for c in cs) + ") AS ok(t, c)"
_COUNTRIES = [country for _, country, _ in dims.DIALECT_CLASSES]


@query("pair_hyp_ref", """
    SELECT coalesce(h.doc_id, r.doc_id) AS doc_id, md5(h.text) AS hyp_digest, md5(r.text) AS ref_digest,
           h.doc_id IS NULL OR r.doc_id IS NULL AS mismatch
    FROM (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 3) h
    FULL JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 7) r ON h.doc_id = r.doc_id""")
def pair_hyp_ref(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paired = O.pair_lines(docs.where("doc_id % 10 <> 3"), docs.where("doc_id % 10 <> 7"), ["doc_id"])
    return paired.select("doc_id", F.md5("hyp").alias("hyp_digest"), F.md5("ref").alias("ref_digest"), "mismatch")


@query("ngram_overlap", f"""
    WITH {T.EDITED},
    {T.windows_of('edited', 'doc_id', 'hyp_tokens', 2, 'hw')}, {T.windows_of('edited', 'doc_id', 'ref_tokens', 2, 'rw')},
    hg AS (SELECT doc_id, ord, gram, count(*) AS n FROM (
             SELECT doc_id, 1 AS ord, {T.gram(1, ' ')} AS gram FROM hw UNION ALL
             SELECT doc_id, 2, {T.gram(2, ' ')} FROM hw) WHERE gram IS NOT NULL GROUP BY ALL),
    rg AS (SELECT doc_id, ord, gram, count(*) AS n FROM (
             SELECT doc_id, 1 AS ord, {T.gram(1, ' ')} AS gram FROM rw UNION ALL
             SELECT doc_id, 2, {T.gram(2, ' ')} FROM rw) WHERE gram IS NOT NULL GROUP BY ALL),
    ords AS (SELECT doc_id, unnest([1, 2]) AS ord FROM documents)
    SELECT doc_id, ord::INT AS "order", coalesce(h, 0)::BIGINT AS hyp_grams, coalesce(r, 0)::BIGINT AS ref_grams,
           coalesce(m, 0)::BIGINT AS matches
    FROM ords LEFT JOIN (SELECT doc_id, ord, sum(n) AS h FROM hg GROUP BY ALL) USING (doc_id, ord)
    LEFT JOIN (SELECT doc_id, ord, sum(n) AS r FROM rg GROUP BY ALL) USING (doc_id, ord)
    LEFT JOIN (SELECT hg.doc_id, hg.ord, sum(least(hg.n, rg.n)) AS m FROM hg JOIN rg
               ON hg.doc_id = rg.doc_id AND hg.ord = rg.ord AND hg.gram = rg.gram GROUP BY ALL) USING (doc_id, ord)""")
def ngram_overlap(spark, sf_dir):
    return O.gram_overlap(edited_documents(spark, sf_dir), ["doc_id"], "hyp_tokens", "ref_tokens", 2)


_CHRF_STATS = f"""
    {T.EDITED},
    {T.gram_counts('edited', 'doc_id', 'hyp', 'hg')}, {T.gram_counts('edited', 'doc_id', 'ref', 'rg')},
    ords AS (SELECT doc_id, lang, unnest(range(1, 9)) AS ord FROM documents),
    stats AS (
        SELECT doc_id, lang, ord, CASE WHEN coalesce(r, 0) = 0 THEN 0 ELSE coalesce(h, 0) END AS h,
               coalesce(r, 0) AS r, coalesce(m, 0) AS m
        FROM ords LEFT JOIN (SELECT doc_id, ord, sum(n) AS h FROM hg GROUP BY ALL) USING (doc_id, ord)
        LEFT JOIN (SELECT doc_id, ord, sum(n) AS r FROM rg GROUP BY ALL) USING (doc_id, ord)
        LEFT JOIN (SELECT hg.doc_id, hg.ord, sum(least(hg.n, rg.n)) AS m FROM hg JOIN rg
                   ON hg.doc_id = rg.doc_id AND hg.ord = rg.ord AND hg.gram = rg.gram GROUP BY ALL) USING (doc_id, ord))"""


@query("sentence_chrf", f"""
    WITH {_CHRF_STATS} SELECT doc_id, {T.r6('chrf')} AS chrf FROM ({T.chrf_from('stats', 'doc_id')})""")
def sentence_chrf(spark, sf_dir):
    return O.sentence_chrf(edited_documents(spark, sf_dir)).select("doc_id", r6("chrf").alias("chrf"))


@query("corpus_chrf", f"""
    WITH {_CHRF_STATS},
    summed AS (SELECT lang, ord, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM stats GROUP BY ALL)
    SELECT lang, n, {T.r6('100 * chrf')} AS chrf FROM ({T.chrf_from('summed', 'lang')})
    JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)""")
def corpus_chrf(spark, sf_dir):
    scores = O.corpus_chrf(edited_documents(spark, sf_dir), ["lang"])
    return scores.select("lang", "n", r6("chrf").alias("chrf"))


def _bleu_sql(by: str, edited: str) -> str:
    """CTEs that end in ``bleus(by, bleu)``."""
    union = " UNION ALL ".join(f"SELECT doc_id, {n} AS ord, {T.gram(n, ' ')} AS gram FROM {{w}}" for n in range(1, 5))
    return f"""
    {T.windows_of(edited, 'doc_id', 'hyp_tokens', 4, 'bh')}, {T.windows_of(edited, 'doc_id', 'ref_tokens', 4, 'br')},
    bhg AS (SELECT doc_id, ord, gram, count(*) AS n FROM ({union.format(w='bh')}) WHERE gram IS NOT NULL GROUP BY ALL),
    brg AS (SELECT doc_id, ord, gram, count(*) AS n FROM ({union.format(w='br')}) WHERE gram IS NOT NULL GROUP BY ALL),
    lens AS (SELECT {by}, sum(len(hyp_tokens)) AS sys, sum(len(ref_tokens)) AS ref FROM {edited} GROUP BY {by}),
    prec AS (SELECT {by}, ord, sum(bhg.n) AS h, sum(least(bhg.n, coalesce(brg.n, 0))) AS m
             FROM bhg LEFT JOIN brg USING (doc_id, ord, gram) JOIN {edited} USING (doc_id) GROUP BY {by}, ord),
    smooth AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY {by} ORDER BY ord) AS k FROM prec),
    bleus AS (SELECT {by}, CASE WHEN sum(m) = 0 THEN 0 WHEN count(*) < 4 THEN 0 ELSE
                100 * exp(sum(CASE WHEN m = 0 THEN ln(1 / (pow(2, k) * h)) ELSE ln(m::DOUBLE / h) END) / 4)
                * CASE WHEN any_value(sys) < any_value(ref) THEN exp(1 - any_value(ref)::DOUBLE / any_value(sys)) ELSE 1 END END::DOUBLE AS bleu
              FROM smooth JOIN lens USING ({by}) GROUP BY {by})"""


@query("corpus_bleu", f"""
    WITH {T.EDITED}, {_bleu_sql('lang', 'edited')}
    SELECT lang, n, {T.r6('bleu')} AS bleu FROM bleus
    JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)""")
def corpus_bleu(spark, sf_dir):
    scores = O.corpus_bleu(edited_documents(spark, sf_dir), ["lang"], "hyp_tokens", "ref_tokens")
    return scores.select("lang", "n", r6("bleu").alias("bleu"))


@query("corpus_bleu_subwords")
def corpus_bleu_subwords(spark, sf_dir):
    """BLEU over the pieces of a public subword model, which SQL cannot make."""
    pieces = subword_tokens(spark, public_tokenizers.path("piece_bpe_32k.model"))
    pairs = edited_documents(spark, sf_dir).select("lang", pieces(F.col("hyp")).alias("hyp_pieces"), pieces(F.col("ref")).alias("ref_pieces"))
    return O.corpus_bleu(pairs, ["lang"], "hyp_pieces", "ref_pieces").select("lang", "n", r6("bleu").alias("bleu"))


_DIRECTIONS = dims.directions(dims.REPORT_DIALECTS)
_DIRECTION_LIST = "[" + ", ".join(f"'{d}'" for d in _DIRECTIONS) + "]"


@query("mt_report", f"""
    WITH {_CHRF_STATS},
    tagged AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'madar' ELSE 'flores' END AS corpus,
                      {_DIRECTION_LIST}[(doc_id // 2) % 21 + 1] AS direction FROM edited),
    named AS (SELECT *, corpus || '/' || coalesce(direction, '') AS cell FROM tagged),
    {_bleu_sql('cell', 'named')},
    summed AS (SELECT cell, ord, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM stats JOIN named USING (doc_id) GROUP BY ALL),
    chrfs AS ({T.chrf_from('summed', 'cell')}),
    grid AS (SELECT corpus, direction, corpus || '/' || direction AS cell
             FROM (SELECT unnest(['madar', 'flores']) AS corpus), (SELECT unnest({_DIRECTION_LIST}) AS direction))
    SELECT corpus, direction, coalesce(n, 0) AS n, {T.r6('coalesce(chrf * 100, 0)')} AS chrf, {T.r6('coalesce(bleu, 0)')} AS bleu
    FROM grid LEFT JOIN chrfs USING (cell) LEFT JOIN bleus USING (cell)
    LEFT JOIN (SELECT cell, count(*) AS n FROM named GROUP BY cell) USING (cell)""")
def mt_reports(spark, sf_dir):
    # One cell in 21 has no direction, so some grid cells differ in size.
    direction = F.get(F.array(*[F.lit(d) for d in _DIRECTIONS]), F.floor(F.col("doc_id") / 2) % 21)
    pairs = edited_documents(spark, sf_dir).select(
        "*", F.when(F.col("doc_id") % 2 == 0, "madar").otherwise("flores").alias("corpus"),
        direction.alias("direction"),
    )
    return mt_report(pairs).select("corpus", "direction", "n", r6("chrf").alias("chrf"), r6("bleu").alias("bleu"))


@query("avg_lengths", f"""
    WITH {T.EDITED}
    SELECT lang, {T.r6('avg(len(hyp_tokens))')} AS avg_hyp_len, {T.r6('avg(len(ref_tokens))')} AS avg_ref_len
    FROM edited GROUP BY lang""")
def avg_lengths(spark, sf_dir):
    lengths = average_lengths(edited_documents(spark, sf_dir), ["lang"], "hyp_tokens", "ref_tokens")
    return lengths.select("lang", r6("avg_hyp_len").alias("avg_hyp_len"), r6("avg_ref_len").alias("avg_ref_len"))


_LOGITS = """
    logits AS (SELECT vec_id, embedding[19]::DOUBLE AS dialectness, list_transform(embedding[1:18], lambda x: x::DOUBLE) AS l FROM embeddings),
    cls AS (SELECT vec_id, dialectness, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS idx FROM logits),
    probs AS (SELECT vec_id, dialectness, idx, exp(x - max(x) OVER v) / sum(exp(x - m)) OVER v AS p
              FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM cls) WINDOW v AS (PARTITION BY vec_id))"""


def _vectors(spark, sf_dir):
    # The dialect runs through the 18 codes and two unknown ones.
    codes = F.array(*[F.lit(c) for c in [*_COUNTRIES, "msa", "pes"]])
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 18).cast("array<double>").alias("logits"),
        F.get("embedding", F.lit(18)).cast("double").alias("dialectness"),
        F.get(codes, F.col("vec_id") % 20).alias("dialect"),
    )


_CODES_SQL = "[" + ", ".join(f"'{c}'" for c in [*_COUNTRIES, "msa", "pes"]) + "]"


@query("softmax_array", f"WITH {_LOGITS} SELECT vec_id, idx::INT AS idx, {T.r6('p')} AS p FROM probs")
def softmax_array(spark, sf_dir):
    probs = _vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.softmax(F.col("logits"))).alias("idx", "p"))
    return probs.select("vec_id", "idx", r6("p").alias("p"))


_TARGETS = f"""
    {_LOGITS},
    target AS (SELECT vec_id, {_CODES_SQL}[vec_id % 20 + 1] AS dialect FROM embeddings),
    scored AS (SELECT t.vec_id, t.dialect, d.class_idx,
                      sum(CASE WHEN probs.idx = d.class_idx THEN p END) AS prob,
                      sum(CASE WHEN e.macro = d.macro THEN p ELSE 0 END) AS macro_prob, any_value(dialectness) AS dialectness
               FROM target t JOIN probs USING (vec_id) LEFT JOIN {T.CLASS_VALUES.replace('dim(', 'd(')} ON d.country = t.dialect
               JOIN {T.CLASS_VALUES.replace('dim(', 'e(')} ON e.class_idx = probs.idx GROUP BY ALL)"""


@query("target_prob", f"""
    WITH {_TARGETS} SELECT vec_id, dialect, {T.r6('prob')} AS prob FROM scored""")
def target_prob(spark, sf_dir):
    return D.target_probs(_vectors(spark, sf_dir)).select("vec_id", "dialect", r6("prob").alias("prob"))


@query("macro_prob", f"""
    WITH {_TARGETS}
    SELECT vec_id, dialect, CASE WHEN class_idx IS NOT NULL THEN {T.r6('macro_prob')} END AS macro_prob FROM scored""")
def macro_prob(spark, sf_dir):
    return D.target_probs(_vectors(spark, sf_dir)).select("vec_id", "dialect", r6("macro_prob").alias("macro_prob"))


@query("dialect_dims", f"""
    SELECT vec_id, dialect, coalesce(class_idx, -1)::INT AS class_idx, dialect_name, macro
    FROM (SELECT vec_id, {_CODES_SQL}[vec_id % 20 + 1] AS dialect FROM embeddings)
    LEFT JOIN {T.CLASS_VALUES} ON country = dialect""")
def dialect_dims(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("vec_id", "dialect")
    return D.with_dialect_class(vectors).select(
        "vec_id", "dialect", F.coalesce("class_idx", F.lit(-1)).alias("class_idx"), "dialect_name", "macro"
    )


@query("unknown_dialects", f"""
    SELECT dialect, count(*) AS n FROM (SELECT {_CODES_SQL}[vec_id % 20 + 1] AS dialect FROM embeddings)
    WHERE dialect IN ('msa', 'pes') GROUP BY dialect""")
def unknown_dialects(spark, sf_dir):
    return D.unknown_dialects(_vectors(spark, sf_dir).select("dialect"))


_TASKS = {t: "[" + ", ".join(f"'{x}'" for x in targets) + "]" for t, targets in dims.TASK_TARGETS.items()}


@query("task_coverage", f"""
    SELECT task, target, count(e.vec_id) AS n
    FROM (SELECT 'monolingual' AS task, unnest({_TASKS['monolingual']}) AS target
          UNION ALL SELECT 'crosslingual', unnest({_TASKS['crosslingual']})
          UNION ALL SELECT 'mt', unnest({_TASKS['mt']}))
    LEFT JOIN (SELECT vec_id, {_CODES_SQL}[vec_id % 20 + 1] AS dialect FROM embeddings) e
      ON e.dialect = target OR (e.vec_id % 3 = 0 AND 'eng-' || e.dialect = target)
    GROUP BY ALL""")
def task_coverage(spark, sf_dir):
    """Rows per expected (task, target), zero where nothing was produced."""
    vectors = _vectors(spark, sf_dir).select("vec_id", "dialect")
    made = vectors.select(F.col("dialect").alias("target")).unionAll(
        vectors.where("vec_id % 3 = 0").select(F.concat(F.lit("eng-"), "dialect"))
    ).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return dims.task_grid(spark).join(made, "target", "left").fillna(0, ["n"])


@query("lid_gate", f"""
    SELECT doc_id, lang AS code, target_lang, c IS NOT NULL AS lid_ok
    FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'rom' ELSE 'eng' END AS target_lang FROM documents)
    LEFT JOIN {_ALLOWED_SQL} ON t = target_lang AND c = lang""")
def lid_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("code"), F.when(F.col("doc_id") % 3 == 0, "rom").otherwise("eng").alias("target_lang")
    )
    return D.with_lid_gate(docs, allowed=ALLOWED)


_SETS = [(s, c) for s, corpora in dims.FIDELITY_CORPORA.items() for c in corpora]
_SET_LIST = "[" + ", ".join(f"'{s}'" for s, _ in _SETS) + "]"
_CORPUS_LIST = "[" + ", ".join(f"'{c}'" for _, c in _SETS) + "]"

_FIDELITY = f"""
    {_TARGETS},
    docs AS (SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN '  ' ELSE text END AS text,
                    '__label__' || lang AS label, CASE WHEN doc_id % 3 = 0 THEN 'rom' ELSE 'eng' END AS target_lang,
                    {_SET_LIST}[substr(source, 4)::INT % 7 + 1] AS lang_set, {_CORPUS_LIST}[substr(source, 4)::INT % 7 + 1] AS corpus,
                    doc_id % (SELECT count(*) FROM embeddings) AS vec_id FROM documents),
    rows AS (SELECT doc_id, lang_set, corpus, dialect,
                    CASE WHEN good THEN prob ELSE 0 END AS prob, CASE WHEN good THEN d ELSE 0 END AS dialectness,
                    CASE WHEN good THEN prob * d ELSE 0 END AS score, CASE WHEN good THEN macro_prob * d ELSE 0 END AS macro_score
             FROM (SELECT docs.*, s.dialect, s.prob, s.macro_prob, greatest(0, least(1, s.dialectness)) AS d,
                          trim(docs.text) <> '' AND ok.c IS NOT NULL AND s.class_idx IS NOT NULL AS good
                   FROM docs JOIN scored s USING (vec_id)
                   LEFT JOIN {_ALLOWED_SQL} ON ok.t = target_lang AND ok.c = label[10:12]))"""


def _classed_documents(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    n = vectors.count()
    slot = F.substring("source", 4, 9).cast("int") % 7
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 13 == 5, "  ").otherwise(F.col("text")).alias("text"),
        lid_code(F.concat(F.lit("__label__"), "lang")).alias("code"),
        F.when(F.col("doc_id") % 3 == 0, "rom").otherwise("eng").alias("target_lang"),
        F.get(F.array(*[F.lit(s) for s, _ in _SETS]), slot).alias("lang_set"),
        F.get(F.array(*[F.lit(c) for _, c in _SETS]), slot).alias("corpus"),
        (F.col("doc_id") % n).alias("vec_id"),
    )
    return docs.join(vectors, "vec_id")


def _fidelity_rows(spark, sf_dir):
    return D.fidelity_rows(_classed_documents(spark, sf_dir), allowed=ALLOWED)


_METRICS_SQL = ", ".join(f"{T.r6(f'coalesce(avg({m}), 0)')} AS {m}" for m in D.METRICS)


@query("fidelity_scores", f"""
    WITH {_FIDELITY} SELECT corpus, dialect, count(*) AS n, {_METRICS_SQL} FROM rows GROUP BY corpus, dialect""")
def fidelity_scores(spark, sf_dir):
    scores = D.fidelity_scores(_fidelity_rows(spark, sf_dir), ["corpus", "dialect"])
    return scores.select("corpus", "dialect", "n", *[r6(m).alias(m) for m in D.METRICS])


_DIALECT_LIST = "[" + ", ".join(f"'{d}'" for d in dims.REPORT_DIALECTS) + "]"
_GRID_SQL = f"""(SELECT s AS lang_set, c AS corpus, unnest({_DIALECT_LIST}) AS dialect FROM (VALUES
    {', '.join(f"('{s}', '{c}')" for s, c in _SETS)}) AS cells(s, c))"""


@query("fidelity_report", f"""
    WITH {_FIDELITY}
    SELECT lang_set, corpus, dialect, count(doc_id) AS n, {_METRICS_SQL}
    FROM {_GRID_SQL} LEFT JOIN rows USING (lang_set, corpus, dialect) GROUP BY lang_set, corpus, dialect""")
def fidelity_report(spark, sf_dir):
    report = D.fidelity_report(_fidelity_rows(spark, sf_dir))
    return report.select("lang_set", "corpus", "dialect", "n", *[r6(m).alias(m) for m in D.METRICS])


@query("fidelity_macro", f"""
    WITH {_FIDELITY}, cells AS (
        SELECT lang_set, corpus, dialect, {', '.join(f'coalesce(avg({m}), 0) AS {m}' for m in D.METRICS)}
        FROM {_GRID_SQL} LEFT JOIN rows USING (lang_set, corpus, dialect) GROUP BY ALL)
    SELECT lang_set, {', '.join(f"{T.r6(f'avg({m})')} AS {m}" for m in D.METRICS)} FROM cells GROUP BY lang_set""")
def fidelity_macro(spark, sf_dir):
    macro = macro_score(D.fidelity_report(_fidelity_rows(spark, sf_dir)), ["lang_set"], list(D.METRICS))
    return macro.select("lang_set", *[r6(m).alias(m) for m in D.METRICS])


@query("fidelity_counts", f"""
    WITH {_FIDELITY}, files AS (SELECT coalesce(corpus, 'unlisted') AS corpus, dialect, count(*) AS n FROM rows GROUP BY ALL)
    SELECT corpus, sum(n)::BIGINT AS n, count(*) AS k FROM files GROUP BY ROLLUP (corpus)""")
def fidelity_counts(spark, sf_dir):
    return D.fidelity_counts(_fidelity_rows(spark, sf_dir).withColumn("corpus", F.coalesce("corpus", F.lit("unlisted"))))


@query("report_leftovers", f"""
    WITH {_FIDELITY}
    SELECT lang_set, corpus, dialect, count(*) AS n FROM rows
    WHERE NOT EXISTS (SELECT 1 FROM {_GRID_SQL} g
                      WHERE g.lang_set = rows.lang_set AND g.corpus = rows.corpus AND g.dialect = rows.dialect)
    GROUP BY ALL""")
def report_leftovers(spark, sf_dir):
    return D.report_leftovers(_fidelity_rows(spark, sf_dir))


# Documents as output files of so many lines each, ordered by id.
_FILE_LINES = 1000


@query("stream_scored_lines", f"""
    WITH {_FIDELITY},
    placed AS (SELECT doc_id, doc_id // {_FILE_LINES} AS file,
                      row_number() OVER (PARTITION BY doc_id // {_FILE_LINES} ORDER BY doc_id) - 1 AS line_idx,
                      replace(text, chr(10), ' ') AS line FROM docs),
    {T.repetition('placed', 'doc_id', 'line', 'reps')}
    SELECT file::VARCHAR AS file, line_idx, trim(line) = '' AS blank,
           {T.r6('greatest(w4, c8, run)')} AS word_rep_penalty, {T.r6('greatest(rep, loop)')} AS sent_rep_penalty,
           {T.r6('score')} AS score, {T.r6('macro_score')} AS macro_score
    FROM placed JOIN reps USING (doc_id) JOIN rows USING (doc_id)""")
def stream_scored_lines(spark, sf_dir):
    """Documents written as output files, then scored as a stream of their lines that joins the models' numbers by line number."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = _classed_documents(spark, sf_dir).withColumn("file", F.floor(F.col("doc_id") / _FILE_LINES).cast("string"))
    lines = docs.select("file", "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "doc_id").drop("doc_id").write.partitionBy("file").text(f"{folder}/outputs")
    # Only keys are sorted; what the models said joins them by document.
    numbers = number_rows(docs.select("file", "doc_id"), ["file"], [F.asc("doc_id")], "line_idx").withColumn("line_idx", F.col("line_idx") - 1)
    numbers = numbers.join(docs.drop("text", "file"), "doc_id")

    def classes(arrived):
        placed = arrived.withColumn("file", F.regexp_extract("source", "file=([0-9]+)/", 1))
        return placed.join(numbers, ["file", "line_idx"])

    live.score_arriving_files(spark, f"{folder}/outputs", f"{folder}/scored", f"{folder}/state", classes, suffix=".txt", allowed=ALLOWED)
    return spark.read.parquet(f"{folder}/scored/lines").select(
        "file", "line_idx", "blank", *[r6(c).alias(c) for c in ("word_rep_penalty", "sent_rep_penalty", "score", "macro_score")]
    )


@query("manifest_mismatch", """
    WITH listed AS (SELECT source || '.out' AS source, min(lang) AS dialect FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL
                    UNION ALL SELECT 'gone' || item_id, 'nowhere' FROM benchmark),
    counts AS (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '.txt' ELSE source || '.out' END AS source, count(*) AS n
               FROM documents GROUP BY ALL)
    SELECT source, dialect, coalesce(n, 0) AS n FROM listed FULL JOIN counts USING (source) WHERE dialect IS NULL OR n IS NULL""")
def manifest_mismatch(spark, sf_dir):
    """Documents as output lines of files, of which one kind of name is not listed, and listed files that are not there."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    lines = docs.select(F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".out")).alias("source"))
    listed = docs.where("doc_id % 5 <> 0").groupBy(F.concat("source", F.lit(".out")).alias("source")).agg(F.min("lang").alias("dialect"))
    gone = items.select(F.concat(F.lit("gone"), "item_id").alias("source"), F.lit("nowhere").alias("dialect"))
    return D.manifest_mismatch(lines, listed.unionByName(gone))
