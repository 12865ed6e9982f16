"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Built-in functions only.  The patterns are written so that each takes time in
proportion to the text: runs are taken possessively and only begun at their start.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import whole
from textloom.llm.spans import any_case, count_of, located, written

BASE_KINDS = ("email", "ip", "card", "phone")
# Characters before a span that are searched for context words.
CONTEXT_CHARS = 40
THRESHOLD = 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """``score`` of a span by itself, ``boost`` if a context word stands before it; kept from THRESHOLD on."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    context: tuple[str, ...]
    score: float
    boost: float
    # A character without which the text holds no match, to spare the search.
    needs: str | None = None
    # No ASCII letter or digit may stand right before or behind a span.
    apart: bool = False


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def mod97(found: Column) -> Column:
    """Whether the account number's letters-as-numbers form leaves 1 when divided by 97."""
    bare = F.regexp_replace(found, " ", "")
    turned = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1))), F.lit(0),
        lambda acc, c: (acc * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + F.conv(c, 36, 10).cast("int")) % 97,
    )
    return F.length(bare).between(15, 34) & (rest == 1)


KINDS = (
    Kind(
        # A run of local characters is tried at its start, or right behind the match before.
        "email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None,
        ("mail", "contact"), 0.8, 0.1, "@",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda found: found.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"), ("ip", "address", "host"), 0.6, 0.3, ".",
    ),
    Kind(
        # A whole run of digits with single separators, of the right length.
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        lambda found: F.call_function("luhn_check", digits(found)), ("card", "credit", "visa", "payment"), 0.7, 0.2,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda found: F.length(digits(found)).between(8, 15),
        ("phone", "tel", "call", "mobile"), 0.6, 0.3, "+",
    ),
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        mod97, ("iban", "account", "bank"), 0.7, 0.2, apart=True,
    ),
    Kind(
        # Shape alone is not enough: a context word must lift it over the threshold.
        "ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda found: ~found.rlike("^(?:000|666|9)|-00-|-0000"),
        ("ssn", "social security"), 0.3, 0.4, "-", apart=True,
    ),
)


def pii_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii): per row of ``docs`` its spans, as structs (kind, start, stop, found, score).

    Spans are ordered by kind as listed in KINDS, then by start; places count code
    points, ends are exclusive.  Null text counts as empty and has no spans.  Only
    the two named columns are read; repeated rows each keep their row.
    """
    texts = docs.select(F.col(doc_id), whole(text).alias("_text"))
    # One column a kind first: each pattern runs once over a text.
    proposed = texts.select("*", *(_proposed(F.col("_text"), kind).alias(f"_{kind.name}") for kind in KINDS))
    return proposed.select(doc_id, F.concat(*(_scored(kind) for kind in KINDS)).alias("pii"))


def _proposed(text: Column, kind: Kind) -> Column:
    spans = located(text, kind.pattern)
    if kind.needs is not None:
        spans = F.when(F.contains(text, F.lit(kind.needs)), spans)
    return spans


def _scored(kind: Kind) -> Column:
    spans = F.col(f"_{kind.name}")
    if kind.valid is not None:
        spans = F.filter(spans, lambda s: kind.valid(s["found"]))
    if kind.apart:
        spans = F.filter(spans, lambda s: ~F.concat(
            F.when(s["start"] > 0, F.substring(F.col("_text"), s["start"], F.lit(1))).otherwise(""),
            F.substring(F.col("_text"), s["stop"] + 1, F.lit(1)),
        ).rlike("[A-Za-z0-9]"))
    words = rf"(?<![A-Za-z])(?:{'|'.join(any_case(w) for w in kind.context)})"

    def scored(s: Column) -> Column:
        reach = F.least(F.lit(CONTEXT_CHARS), s["start"])
        before = F.substring(F.col("_text"), s["start"] - reach + 1, reach)
        score = F.lit(kind.score) + F.when(before.rlike(words), kind.boost).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"], s["stop"], s["found"], score.alias("score"))

    kept = F.filter(F.transform(spans, scored), lambda s: s["score"] >= THRESHOLD)
    return F.coalesce(kept, F.array().cast("array<struct<kind:string,start:int,stop:int,found:string,score:double>>"))


def pii_digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of ``pii_spans`` per row."""
    found = pii_spans(docs, doc_id=doc_id, text=text)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: written(s["kind"], s)), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        doc_id,
        *(count_of("pii", kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
