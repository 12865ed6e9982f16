"""Places of pattern matches in a text, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,found:string>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, stop, found), in code points, end exclusive.

    The pieces between matches and the matches alternate, so their lengths give
    the places.  The text is only cut into pieces where there is a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        F.split(text, pattern, -1), found,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("found")),
    )
    # The last piece has no match behind it.
    pairs = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + pair["gap"]
        end = begin + F.length(pair["found"])
        span = F.struct(begin.alias("start"), end.alias("stop"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    placed = F.aggregate(pairs, start, step, lambda done: done["spans"])
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast(SPAN))


def written(kind: Column | str, span: Column) -> Column:
    """``kind:start:stop``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", kind, span["start"].cast("string"), span["stop"].cast("string"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def any_case(word: str) -> str:
    """A pattern of ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
