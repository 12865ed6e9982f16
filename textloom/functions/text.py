"""Clean-up and splitting of text with Python's idea of white space.

Spark's ``trim`` knows only the space and ``\\s`` only ASCII; the 29 characters
for which ``str.isspace`` holds are spelled out once and used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
]
SPACES = "".join(chr(c) for lo, hi in _SPACE_RANGES for c in range(lo, hi + 1))
SPACE_CLASS = "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in _SPACE_RANGES) + "]"

# The same class for Java: one bit set for Latin-1, and a single range test that
# sends other letters past the wide spaces.
_SPACE = (
    r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]"
)

# The marks that end a sentence (Latin, Arabic, Chinese/Japanese).
SENTENCE_MARKS = ".!?؟؛;。！？"
_SENTENCE_END = r"[.!?;[\u061B-\uFF1F&&[؟؛。！？]]]"

# The markers a CSV reader takes as "no value".
NA_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Strip, then turn each run of white space into one space."""
    return F.regexp_replace(strip(text), _SPACE + "+", " ")


def null_to_empty(text: Column) -> Column:
    """Null becomes the empty string; nothing else changes."""
    return F.coalesce(text, F.lit(""))


def normalize_text(text: Column) -> Column:
    """Null and the word "nan" become empty, everything else is stripped."""
    stripped = strip(null_to_empty(text))
    return F.when(F.lower(stripped) == "nan", F.lit("")).otherwise(stripped)


def clean_text(text: Column) -> Column:
    """One line per text: newlines to spaces, then strip."""
    return strip(F.translate(null_to_empty(text), "\n", " "))


def blank_na(text: Column, markers: list[str] | None = None) -> Column:
    """Null out the markers that stand for a missing cell."""
    return F.when(~text.isin(NA_MARKERS if markers is None else markers), text)


def escape_newlines(text: Column) -> Column:
    """Write a newline as backslash-n, so one text stays one line."""
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    pieces = F.split(strip(null_to_empty(text)), _SPACE + "+")
    return F.array_remove(pieces, "")


def split_sentences(text: Column) -> Column:
    """Sentences of a text.  Newlines count as spaces, not as sentence ends."""
    pieces = F.split(collapse(null_to_empty(text)), _SENTENCE_END + "+")
    return F.array_remove(F.transform(pieces, lambda s: F.trim(s)), "")


def lid_code(label: Column) -> Column:
    """Three-letter code of a language label such as ``__label__arb_Arab``."""
    prefix = "__label__"
    return F.when(label.startswith(prefix), F.substring(label, len(prefix) + 1, 3)).otherwise(label)


def first_nonempty(*columns: Column, default: str | None = None) -> Column:
    """First column that is neither null nor empty."""
    candidates = [F.nullif(c, F.lit("")) for c in columns]
    if default is not None:
        candidates.append(F.lit(default))
    return F.coalesce(*candidates)
