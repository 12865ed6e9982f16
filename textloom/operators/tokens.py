"""Token ids: vocabulary table, encoding, masked training rows, model hooks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.arrays import mask_labels, supervised_share, take
from textloom.operators.slices import number_rows

# A vocabulary of at most this many bytes is sent to every executor.
BROADCAST_BYTES = 64 << 20
_ENTRY_BYTES = 48
# Characters whose pieces are Python strings at one time.
_PIECED_CHARS = 1 << 18
# Bytes of texts, or of their pieces, that a task's Python worker gets at one time, a row at least.
_BATCH_BYTES = 4 << 20


def build_vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """``token, freq, id``: ids from 0 by falling frequency, then by token."""
    counts = (
        df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    )
    numbered = number_rows(counts, [], [F.desc("freq"), F.asc("token")], "id")
    return numbered.withColumn("id", (F.col("id") - 1).cast("bigint"))


def encode(df: DataFrame, keys: Sequence[str], tokens: str, vocabulary: DataFrame, out: str = "input_ids") -> DataFrame:
    """``keys, out``: the token ids of each row in order.

    Rows are partitioned by key first, so with a small vocabulary (its bytes are
    summed) the arrays are rebuilt where they were taken apart; a large one is
    joined by token with hot tokens split by the adaptive join.
    """
    table = vocabulary.select("token", "id")
    size = vocabulary.agg(F.sum(F.octet_length("token") + F.lit(_ENTRY_BYTES))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    taken_apart = df.repartition(*keys).select(*keys, F.posexplode_outer(tokens).alias("pos", "token"))
    rebuilt = taken_apart.join(table, "token", "left").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))).alias("_p")
    )
    return rebuilt.select(*keys, F.col("_p.id").alias(out))


def tokenize(df: DataFrame, text: str, make_encoder: Callable[[], Callable[[str], list[int]]], out: str = "input_ids") -> DataFrame:
    """Add token ids from a user's encoder, built once per Python worker."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield texts.fillna("").map(encoder)

    return df.withColumn(out, run(F.col(text)))


def subword_tokens(spark: SparkSession, model_path: str) -> Callable[[Column], Column]:
    """What turns a text column into its subword pieces, by a public sentencepiece model.

    The model is a file the driver can read; executors get its content.  Null counts as
    empty and has no pieces.  The result serves as ``tokens`` of the evaluation jobs.
    A task holds the pieces of a few texts at a time: Arrow batches of this session are cut by bytes.
    """
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    # A batch is held by the JVM and by a worker, for the texts and for what is made of them.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    encoders = []

    # Not over an iterator: two such columns would have a Python worker each.
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        from sentencepiece import SentencePieceProcessor

        if not encoders:
            encoders.append(SentencePieceProcessor(model_proto=model.value))
        kind = pa.list_(pa.string())
        made, few, chars = [pa.array([], kind)], [], 0
        for text in texts:
            few.append(text.as_py() or "")
            chars += len(few[-1])
            if chars >= _PIECED_CHARS:
                made.append(pa.array(encoders[0].encode(few, out_type=str, num_threads=1), kind))
                few, chars = [], 0
        return pa.concat_arrays([*made, pa.array(encoders[0].encode(few, out_type=str, num_threads=1), kind)])

    return lambda text: run(text)


def length_batches(sizes: Sequence[int], batch_rows: int, batch_chars: int) -> list[list[int]]:
    """Places of rows of like size, together at most ``batch_rows`` rows and ``batch_chars`` when padded to the longest.

    A row that is larger than ``batch_chars`` is a batch by itself.
    """
    batches: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        # In rising order the newest row is the longest.
        if not batches or len(batches[-1]) >= batch_rows or (len(batches[-1]) + 1) * sizes[i] > batch_chars:
            batches.append([])
        batches[-1].append(i)
    return batches


def _reconciled(given: pd.DataFrame, made: pd.DataFrame, key: Sequence[str]) -> None:
    """Raise, naming a key, if a scorer lost, doubled or reordered rows."""
    if not key:
        if len(made) != len(given):
            raise ValueError(f"the scorer returned {len(made)} rows for {len(given)}")
        return
    want, got = (list(frame[list(key)].itertuples(index=False, name=None)) for frame in (given, made))
    if want == got:
        return
    lost, extra = Counter(want) - Counter(got), Counter(got) - Counter(want)
    what = "lost" if lost else "returned without being given, or twice," if extra else "returned in another order"
    which = next(iter(lost or extra), None) or next(w for w, g in zip(want, got) if w != g)
    raise ValueError(f"the scorer {what} row {dict(zip(key, which))}")


def score_texts(
    df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch_rows: int = 64, *,
    key: Sequence[str] = (), text: str | None = None, batch_chars: int = 1 << 16, hold_rows: int = 4096,
) -> DataFrame:
    """Run a user's model over the rows in small batches.

    The scorer takes a frame of at most ``batch_rows`` rows and returns a frame with the
    columns of ``schema``, one row for each given and in their order.  With ``key``, columns
    that it must hand back, a row that it loses, doubles or moves is an error that names
    the key; without, only their number is compared.  With ``text``, batches are made of
    texts of like length, of at most ``batch_chars`` characters once padded to the longest,
    among ``hold_rows`` rows at a time; results come back in the rows' order.
    """
    def score(scorer, frame: pd.DataFrame) -> pd.DataFrame:
        made = scorer(frame.reset_index(drop=True))
        _reconciled(frame, made, key)
        return made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in batches:
            for start in range(0, len(frame), hold_rows):
                held = frame.iloc[start:start + hold_rows]
                if text is None:
                    for at in range(0, len(held), batch_rows):
                        yield score(scorer, held.iloc[at:at + batch_rows])
                    continue
                sizes = [len(t) if isinstance(t, str) else 0 for t in held[text]]
                parts = length_batches(sizes, batch_rows, batch_chars)
                made = pd.concat([score(scorer, held.iloc[part]) for part in parts], ignore_index=True)
                places = [i for part in parts for i in part]
                yield made.iloc[sorted(range(len(places)), key=places.__getitem__)]

    return df.mapInPandas(run, schema)


def training_row(full_ids: Column, prompt_len: Column, max_length: int) -> list[Column]:
    """``input_ids, attention_mask, labels, n_supervised`` of one row.

    The prompt length is that of the prompt tokenized alone and truncated too.
    """
    ids = take(full_ids, F.lit(max_length))
    labels = mask_labels(ids, F.least(prompt_len, F.lit(max_length)))
    return [
        ids.alias("input_ids"),
        F.transform(ids, lambda _: F.lit(1).cast("bigint")).alias("attention_mask"),
        labels.alias("labels"),
        F.size(F.filter(labels, lambda x: x != -100)).cast("bigint").alias("n_supervised"),
    ]


def label_coverage(df: DataFrame, labels: str, order: Sequence[Column], k: int = 50) -> DataFrame:
    """Mean supervised share of the first k rows."""
    shares = df.select(*order, supervised_share(F.col(labels)).alias("share"))
    return shares.orderBy(*order).limit(k).agg(F.avg("share").alias("coverage"), F.count(F.lit(1)).alias("n"))
