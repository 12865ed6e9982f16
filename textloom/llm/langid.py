"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds a bit per language,
and the slots of an n-gram, ANDed, give all languages that (may) contain it.  A
text counts, per language, its n-grams that the language contains; the expected
false positives of that language's slice are taken off, and the largest share wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, whole

GRAM = 4
SLOTS = 1 << 20
HASHES = 3
# A language contains an n-gram that makes up at least this share of its own; so at most 1/share n-grams each.
LEAST_SHARE = 2e-5
# About so many texts of a language are learned from, taken by the hash of their id.
SAMPLE_PER_LANG = 4000
# So many language names at most; more are no language names.
MOST_LANGUAGES = 1024
UNKNOWN = "und"
_CHARS_AT_ONCE = 1 << 19
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row) of all n-grams over lower-cased letters, each run of other characters taken as one space.

    Texts are set apart, so no n-gram reaches into the next one.
    """
    lowered = [f" {text.lower()} " for text in texts]
    sizes = np.array([len(t) for t in lowered])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = letters[points]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1] | (row[1:] != row[:-1])
    points, row = np.where(letter, points, _SPACE)[kept].astype(np.uint64), row[kept]
    if len(points) < GRAM:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    code = points[:len(points) - GRAM + 1].copy()
    for i in range(1, GRAM):
        code = (code << np.uint64(16)) ^ (code >> np.uint64(48)) ^ points[i:len(points) - GRAM + 1 + i]
    inside = row[:len(code)] == row[GRAM - 1:]
    return code[inside], row[:len(code)][inside]


def slots(codes: np.ndarray, number: int) -> np.ndarray:
    mixed = (codes + np.uint64(number + 1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Filters:
    """Words of 64 languages per slot; ``rates`` are the false positive rates per language."""

    def __init__(self, languages: list[str], known: list[np.ndarray]):
        self.languages = languages
        self.masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        for number, codes in enumerate(known):
            for h in range(HASHES):
                self.masks[slots(codes, h), number // 64] |= np.uint64(1 << number % 64)
        filled = [float((self.masks[:, n // 64] >> np.uint64(n % 64) & np.uint64(1)).mean()) for n in range(len(languages))]
        self.rates = np.array(filled) ** HASHES

    def containing(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of the languages that contain it."""
        out = self.masks[slots(codes, 0)]
        for h in range(1, HASHES):
            out &= self.masks[slots(codes, h)]
        return out

    def shares(self, codes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages) share of n-grams contained, false positives taken off; and n-grams per row."""
        masks = self.containing(codes)
        total = np.bincount(row, minlength=rows).astype(float)
        out = np.zeros((rows, len(self.languages)))
        for n, rate in enumerate(self.rates):
            bits = (masks[:, n // 64] >> np.uint64(n % 64)) & np.uint64(1)
            hits = np.bincount(row, weights=bits.astype(float), minlength=rows)
            out[:, n] = (hits - total * rate) / np.maximum(total * (1 - rate), 1e-9)
        return np.clip(out, 0, 1), total


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > _CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for start, stop in _portions(own):
                codes, counts = np.unique(grams(own[start:stop], letters)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())],
                    names=["lang", "gram", "n"],
                )


def learn(docs: DataFrame, *, doc_id: str, text: str, lang: str, learned: Column,
          sample_per_lang: int = SAMPLE_PER_LANG) -> Filters:
    """Filters from the rows where ``learned`` holds and text and language are there.

    A language with more than ``sample_per_lang`` such rows gives about that many,
    by the hash of the id; n-grams are counted on the cluster and at most
    1 / LEAST_SHARE of a language come to the driver.  More than MOST_LANGUAGES
    different language names are an error.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(learned & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
        (F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)).alias("place"),
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"the table names more than {MOST_LANGUAGES} languages")
    sampled = rows.join(F.broadcast(sizes), "lang").filter(F.col("place") < F.lit(sample_per_lang) / F.col("rows"))
    counted = sampled.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = totals.join(totals.groupBy("lang").agg(F.sum("n").alias("all")), "lang")
    own = shares.filter(F.col("n") >= F.col("all") * LEAST_SHARE).select("lang", "gram").toPandas()
    languages = sorted(own["lang"].unique())
    return Filters(languages, [own["gram"][own["lang"] == name].to_numpy(dtype=np.int64).view(np.uint64) for name in languages])


def identify(docs: DataFrame, filters: Filters, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``.

    ``score`` is the winner's share among all languages' shares.  Ties go to the
    alphabetically first language.  A text without a letter, null or empty is
    ``und`` with score 0, as is every text if nothing was learned.  Only the two
    named columns are read; repeated rows each keep their row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        known = Filters.__new__(Filters)
        known.languages, known.masks, known.rates = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _portions(texts):
                codes, row = grams(texts[start:stop], letters)
                shares, total = known.shares(codes, row, stop - start)
                lettered = np.array([any(map(str.isalpha, t)) for t in texts[start:stop]])
                best = shares.argmax(axis=1) if len(known.languages) else np.zeros(stop - start, dtype=np.int64)
                whole_share = shares.sum(axis=1)
                top = shares.max(axis=1, initial=0)
                score = np.where(lettered & (whole_share > 0), top / np.maximum(whole_share, 1e-12), 0.0)
                best = np.where(lettered, best, len(known.languages))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    names=["_id", "lang_pred", "score"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", doc_id)


def identify_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``identify`` with filters learned from rows outside fold 2 of 4; ``held_out`` marks that fold.

    A row with a null id is in no fold: not learned from and not held out.
    """
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))
    filters = learn(docs, doc_id=doc_id, text=text, lang=lang, learned=fold != 2)
    return identify(docs, filters, doc_id=doc_id, text=text).select(
        doc_id, F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
