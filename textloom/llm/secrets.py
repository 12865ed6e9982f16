"""Secret scans judged by corpus-wide ownership.

Patterns propose candidates.  The hash of each candidate's value is counted over
the whole corpus by distinct owners and distinct repositories: a value that many
owners or many repositories hold is a copied example, one that stays with few of
both looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import kept, row_key, shuffled, whole, whole_rows
from textloom.llm.spans import any_case, count_of, located, written

BASE_KINDS = ("assign", "access", "hex")
# Values in more owners than this are widely copied examples.
MAX_OWNERS = 3
# So are values in more repositories than this, however few owners those have.
MAX_REPOSITORIES = 20
REDACTED = "[SECRET]"

_ASSIGN = (
    "(?:" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{any_case('api')}_?{any_case('key')})"
    r"""["']?\x20*[:=]\x20*["']?"""
)
_VALUE = "[A-Za-z0-9+/_.=-]+"
# kind -> (pattern of the whole match, pattern of the value at its end)
_PATTERNS = {
    "assign": (_ASSIGN + _VALUE, rf"\A{_ASSIGN}({_VALUE})\z"),
    "access": (r"AKIA[A-Z0-9]{16,}+", r"(.+)"),
    # Begun at the start of a run only, so that long runs take linear time.
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", r"(.+)"),
    "bearer": (r"[bB]earer\x20[A-Za-z0-9._~+/-]{20,}+", r"\x20(.+)"),
    "issued": (r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+", r"(.+)"),
    "signed": (r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", r"(.+)"),
}
_KINDS = tuple(_PATTERNS)


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row_key, secrets, and the columns of ``also``): per row its spans as structs (start, rank, kind, stop, digest).

    Ordered by start, then by kind as listed.  ``digest`` is the hash of the value;
    the value itself is not carried.  Null text counts as empty.
    """
    def of_kind(kind: str) -> Column:
        pattern, value = _PATTERNS[kind]
        spans = F.transform(
            located(whole(text), pattern),
            lambda s: F.struct(
                s["start"], F.lit(_KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["stop"],
                F.regexp_extract(s["found"], value, 1).alias("value"),
            ),
        )
        return F.filter(spans, lambda s: F.length(s["value"]) >= 6) if kind == "assign" else spans

    found = docs.select(doc_id, row_key(doc_id, text).alias("row_key"), *also, *(of_kind(k).alias(f"_{k}") for k in _KINDS))
    hashed = F.transform(
        F.array_sort(F.concat(*(f"_{k}" for k in _KINDS))),
        lambda s: F.struct(s["start"], s["rank"], s["kind"], s["stop"], F.sha2(s["value"], 256).alias("digest")),
    )
    return found.select(doc_id, "row_key", hashed.alias("secrets"), *also)


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """(digest, owners, repositories): over how many distinct ones each value spreads.

    ``found`` has one row per row of the corpus with the columns of ``candidates``
    and the two named ones.  A null owner or repository counts as one of its own.
    Counted in three steps, each combined before its shuffle, so a value that a
    third of all rows hold is never gathered in one task.
    """
    held = found.filter(F.size("secrets") > 0).select(
        F.explode(F.array_distinct(F.transform("secrets", lambda s: s["digest"]))).alias("digest"),
        F.col(owner).cast("string").alias("_owner"), F.col(repository).cast("string").alias("_repository"),
    )
    places = held.distinct()
    per_owner = places.groupBy("digest", "_owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("digest").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories")
    )


def scan_secrets(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, row_key, secrets, live).

    ``secrets`` as in ``candidates``; ``live`` holds those whose value stays with at
    most ``max_owners`` owners and ``max_repositories`` repositories.  Null and empty
    texts have none.  Rows with the same id and text have the same result and each keep their row; a null id is an id.
    Only the named columns are read.  An empty table gives an empty table.
    """
    named = docs.select(
        F.col(doc_id).alias("_id"), F.col(text).alias("_text"),
        F.col(owner).alias("_owner"), F.col(repository).alias("_repository"),
    )
    found = kept(candidates(named, doc_id="_id", text="_text", also=("_owner", "_repository")), "secrets")
    owned = ownership(found, "_owner", "_repository").filter(
        (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    )
    held = found.filter(F.size("secrets") > 0).select(
        "row_key", F.explode(F.array_distinct(F.transform("secrets", lambda s: s["digest"]))).alias("digest")
    )
    holders = (
        shuffled(held).join(owned.select("digest"), "digest")
        .groupBy("row_key").agg(F.collect_set("digest").alias("_digests"))
    )
    judged = found.join(holders, "row_key", "left")
    live = F.filter("secrets", lambda s: F.array_contains(F.col("_digests"), s["digest"]))
    return judged.select(
        F.col("_id").alias(doc_id), "row_key", "secrets",
        F.when(F.col("_digests").isNotNull(), live).otherwise(F.slice("secrets", 1, 0)).alias("live"),
    )


def secret_digest(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts and digests of ``scan_secrets`` per row."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: written(s["kind"], s)), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan_secrets(docs, **columns).select(
        columns.get("doc_id", "doc_id"),
        *(count_of("secrets", kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        joined(F.col("live")).alias("live_spans"),
    )


def redacted(text: Column, live: Column) -> Column:
    """``text`` with the live spans cut out and REDACTED in each place; overlaps are cut once."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(done["out"], gap, F.lit(REDACTED))).otherwise(done["out"]).alias("out"),
        )

    ended = F.aggregate(live, state, step)
    return F.concat(ended["out"], F.substring(text, ended["at"] + 1, F.length(text)))


def without_secrets(docs: DataFrame, *, n_chars: str | None = None, **columns: str) -> DataFrame:
    """``docs`` with each live span replaced by REDACTED, all columns kept.

    ``n_chars`` names a column that is to hold the text's new length.
    """
    doc_id, text = columns.get("doc_id", "doc_id"), columns.get("text", "text")
    live = scan_secrets(docs, **columns).filter(F.size("live") > 0).groupBy(F.col("row_key").alias("whole_key")).agg(
        F.first("live").alias("live")
    )
    joined = whole_rows(docs, doc_id, text).join(live, "whole_key", "left")

    def column(name: str) -> Column:
        old = F.col("whole_row")[name]
        clean = redacted(F.coalesce(F.col("whole_row")[text], F.lit("")), F.col("live"))
        new = {text: clean, n_chars: F.length(clean).cast("long")}.get(name, old)
        return F.when(F.col("live").isNotNull(), new).otherwise(old).alias(name)

    return joined.select(*map(column, docs.columns))
