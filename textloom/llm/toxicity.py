"""Toxicity: a linear classifier regularised by counterfactuals.

Labelled texts that name a group are copied with the name swapped for others; the
fit penalises every change of score between a text and its copies, so that neutral
mentions of a group do not raise the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, whole

# At most so many labelled rows of each label are fitted, those of least id hash.
SAMPLE_TOXIC, SAMPLE_OTHER = 1500, 3000
# Features are words and word beginnings; one seen in fewer sampled texts is left out.
PREFIXES = (4, 5, 6)
LEAST_TEXTS = 8
# Share of a text's words at which a feature counts as 1.
UNIT_SHARE = 0.02
# Words added to a text's length, so that one word of a short text does not decide alone.
PRIOR_WORDS = 20
RIDGE = 1e-3
COUNTERFACTUAL = 1.0
STEPS = 150
COPIES = 3

# Names of groups that are swapped for each other.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "gay", "straight", "lesbian", "transgender", "black", "white", "asian", "african",
    "american", "european", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrants", "refugees",
    "disabled", "blind", "deaf", "old", "young",
    "frauen", "männer", "juden", "muslime", "christen", "schwarze", "weiße", "ausländer", "flüchtlinge",
    "femmes", "hommes", "juifs", "musulmans", "chrétiens", "noirs", "blancs", "étrangers", "réfugiés",
    "mujeres", "hombres", "judíos", "musulmanes", "cristianos", "negros", "blancos", "extranjeros", "refugiados",
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word, and its beginnings (marked with a bar, so that they differ from words)."""
    return [word, *(f"{word[:n]}|" for n in PREFIXES if len(word) >= n)]


def dampened(count: int) -> float:
    """What a word counts that stands ``count`` times; repeating one word must not decide alone."""
    return math.log2(1 + count)


class Model:
    """A bias and the weights of features, and the score of a word by them."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= 300_000:
                self.known.clear()
            value = self.known[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return value

    def logit(self, text: str) -> float:
        weighed = [(w, dampened(n)) for w, n in Counter(words_of(text)).items()]
        total = sum([self.word(w) * n for w, n in weighed])
        return self.bias + total / ((sum([n for _, n in weighed]) + PRIOR_WORDS) * UNIT_SHARE)


def labelled_sample(docs: DataFrame, labels: DataFrame, learned: Column, *, doc_id: str, text: str, label: str) -> pa.Table:
    """(toxic, words, counts) of the fitted rows: bounded by SAMPLE_TOXIC and SAMPLE_OTHER, taken by the hash of the id.

    A document labelled twice counts by its largest label; null labels are passed over.
    """
    marked = labels.filter(F.col(label).isNotNull() & learned).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("toxic")
    )
    place = F.xxhash64(F.col("_id").cast("string"))
    chosen = marked.filter("toxic = 1").orderBy(place, "_id").limit(SAMPLE_TOXIC).unionByName(
        marked.filter("toxic = 0").orderBy(place, "_id").limit(SAMPLE_OTHER)
    )
    texts = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    # At most SAMPLE_TOXIC + SAMPLE_OTHER rows, so broadcast; their words come back as counts.
    small_batches(docs.sparkSession)
    found = texts.join(F.broadcast(chosen), "_id").select("_id", "toxic", "_text").mapInArrow(
        _counted, "toxic int, words array<string>, counts array<int>"
    )
    return found.toArrow()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(words_of(text)) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).cast(pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())),
             pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
            names=["toxic", "words", "counts"],
        )


class _Sparse:
    """Rows of (feature, value); a feature may stand in a row more than once."""

    def __init__(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int):
        self.index, self.value, self.row, self.rows = index, value, row, rows

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.index] * self.value, minlength=self.rows)

    def back(self, rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * rows[self.row], minlength=size)


class _Sample:
    """The sampled rows as numbers: for each (row, word) the features of the word and what it counts.

    Words stay in Arrow; only features of at least LEAST_TEXTS rows get a name.
    """

    def __init__(self, sample: pa.Table):
        words, counts = sample["words"].combine_chunks(), sample["counts"].combine_chunks()
        self.rows = len(sample)
        self.row = np.repeat(np.arange(self.rows), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        self.word, self.names = coded.indices.to_numpy(), coded.dictionary
        self.count = counts.flatten().to_numpy().astype(float)
        weighed = np.log2(1 + self.count)
        units = (np.bincount(self.row, weights=weighed, minlength=self.rows) + PRIOR_WORDS) * UNIT_SHARE
        self.value = weighed / units[self.row]
        lengths = pc.utf8_length(self.names).to_numpy()
        self.features: dict[str, int] = {}
        index, value, row = [], [], []
        for n in (None, *PREFIXES):
            begun = self.names if n is None else pc.utf8_slice_codeunits(self.names, 0, n)
            feature = begun.dictionary_encode()
            of_word = feature.indices.to_numpy().copy()
            if n is not None:
                of_word[lengths < n] = -1
            mine = of_word[self.word]
            pairs = np.unique(self.row[mine >= 0] * len(feature.dictionary) + mine[mine >= 0])
            frequent = np.bincount(pairs % max(1, len(feature.dictionary)), minlength=len(feature.dictionary)) >= LEAST_TEXTS
            number = np.where(frequent, np.cumsum(frequent) - 1 + len(self.features), -1)
            kept = number[mine] * (mine >= 0) - (mine < 0)
            index.append(kept[kept >= 0].astype(np.int32))
            value.append(self.value[kept >= 0].astype(np.float32))
            row.append(self.row[kept >= 0].astype(np.int32))
            mark = "" if n is None else "|"
            for name in feature.dictionary.filter(pa.array(frequent)).to_pylist():
                self.features[name + mark] = len(self.features)
        self.texts = _Sparse(np.concatenate(index), np.concatenate(value), np.concatenate(row), self.rows)

    def swaps(self) -> _Sparse:
        """For each row and each group it names, the change of its features when another name stands there."""
        place = {term: i for i, term in enumerate(IDENTITY_TERMS)}
        term_of = np.array([place.get(name, -1) for name in self.names.to_pylist()])
        named = np.flatnonzero(term_of[self.word] >= 0)
        index, value, row, rows = [], [], [], 0
        for at in named:
            term = int(term_of[self.word[at]])
            for step in range(1, COPIES + 1):
                other = (term + 7 * step) % len(IDENTITY_TERMS)
                for name, sign in ((IDENTITY_TERMS[other], 1), (IDENTITY_TERMS[term], -1)):
                    for f in features_of(name):
                        if f in self.features:
                            index.append(self.features[f])
                            value.append(sign * self.value[at])
                            row.append(rows)
                rows += 1
        return _Sparse(np.array(index, dtype=np.int64), np.array(value), np.array(row, dtype=np.int64), rows)


def fit(sample: pa.Table) -> Model:
    """The model of the sampled rows (toxic, words, counts); a constant one if a label is missing."""
    truth = sample["toxic"].to_numpy().astype(float)
    if len(truth) == 0 or truth.min() == truth.max():
        return Model(0.0 if len(truth) == 0 else (5.0 if truth[0] else -5.0), {})
    numbers = _Sample(sample)
    texts, changes, size = numbers.texts, numbers.swaps(), len(numbers.features)
    # Both labels weigh the same.
    weight = np.where(truth == 1, 0.5 / truth.sum(), 0.5 / (len(truth) - truth.sum()))
    w, bias = np.zeros(size), 0.0
    moment, spread = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        logit = texts.times(w) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth)
        slope = texts.back(error, size) + RIDGE * w
        if changes.rows:
            slope += 2 * COUNTERFACTUAL / changes.rows * changes.back(changes.times(w), size)
        slope = np.append(slope, error.sum())
        moment = 0.9 * moment + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope * slope
        move = 0.05 * (moment / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-7)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), {f: float(w[i]) for f, i in numbers.features.items() if abs(w[i]) > 1e-3})


def toxic_score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of a text column of ``docs``, 0 to 1; null counts as empty and gets the bias' score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            logits = np.array([own.logit(t) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    small_batches(docs.sparkSession)
    return score(whole(text))


def score_texts(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``, whole texts.

    Only the two named columns are read, no label among them; repeated rows each
    keep their row, and an empty table gives an empty table.
    """
    scored = docs.select(F.col(doc_id).alias(doc_id), toxic_score(docs, model, text).alias("score"))
    return scored.select(doc_id, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns kept."""
    return docs.filter(toxic_score(docs, model, text) < 0.5)


def fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of labels outside fold 0 of 5; rows with a null id are not learned from."""
    return fit(labelled_sample(docs, labels, fold(doc_id) != 0, doc_id=doc_id, text=text, label=label))


def score_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``score_texts`` by ``learn_toxicity``; ``held_out`` marks fold 0."""
    model = learn_toxicity(docs, labels, doc_id=doc_id, text=text, label=label)
    return score_texts(docs, model, doc_id=doc_id, text=text).select(
        doc_id, F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )
