"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is filed under the one of its literal tokens that the fewest URLs
hold.  A URL fetches the rules filed under its own tokens; only those run their
regular expression.  The longest rule that fits decides.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, lookup

ALLOW, BLOCK = "allow", "block"
# Filed under this token: rules without a literal token; every URL looks here.
_ANY = ""
_SEPARATORS = "[^A-Za-z0-9]+"
_RULE_SCHEMA = "rule string, regex string, tokens array<string>, verdict string"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; ``*`` in it stands for any run."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        """For the host, a slash, and the path."""
        path = ".*".join(_literal(part) for part in self.path.split("*"))
        return rf"(?s)\A(?:[^/]*\.)?{_literal(self.host.lower())}/{path}"

    def tokens(self) -> list[str]:
        """Literal tokens that a fitting URL holds whole: both of their ends are fixed by the rule."""
        bounded = re.findall(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", self.path)
        return sorted({*re.findall("[A-Za-z0-9]+", self.host.lower()), *bounded}) or [_ANY]


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], *, page_id: str = "page_id", url: str = "url", default: str = ALLOW
) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, deciding rule (or null) and verdict.

    Only the id and the url are read, so other columns may have any name.  A null
    url, or one without ``://``, has an empty host and path and gets the default.
    Repeated rows and ids each keep their row.  Of equally long rules the
    alphabetically last decides.  An empty table gives an empty table; without
    rules every row gets the default.
    """
    spark = pages.sparkSession
    parsed = pages.select(
        F.col(page_id), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    filed = _filed(spark.createDataFrame([(r.text, r.regex(), r.tokens(), r.verdict) for r in rules], _RULE_SCHEMA), parsed)
    candidates = _tokens(parsed).join(filed, "token")
    # A host holds no slash, so one more slash sets it apart from the path.
    fitting = candidates.filter(F.rlike(F.concat_ws("/", "host", "path"), F.col("regex")))
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        page_id, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def _tokens(parsed: DataFrame) -> DataFrame:
    """(host, path, token) for each different token of a URL."""
    cut = F.array_distinct(F.concat(F.split(F.concat("host", "path"), _SEPARATORS, -1), F.array(F.lit(_ANY))))
    return parsed.select("host", "path", F.explode(cut).alias("token"))


def _filed(rules: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each rule under its token with the fewest URLs; ties go to the smaller token."""
    wanted = rules.select("*", F.explode("tokens").alias("token")).drop("tokens")
    # Few tokens are rules'; with them broadcast, hot ones are counted where they are read.
    seen = (
        _tokens(parsed).join(lookup(wanted.select("token").distinct(), F.octet_length("token") + 100), "token")
        .groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    )
    counted = wanted.join(seen, "token", "left")
    filed = counted.groupBy("rule", "regex", "verdict").agg(
        F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("least")
    )
    row_bytes = 3 * F.octet_length("rule") + F.octet_length("regex") + 200
    return lookup(filed.select(F.col("least.token").alias("token"), "rule", "regex", "verdict"), row_bytes)
