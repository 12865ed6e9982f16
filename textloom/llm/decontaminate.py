"""Benchmark decontamination: a hash set of test n-grams against the word windows of the corpus.

Built-in functions only.  The windows of each text are hashed inside its row; the
hashes meet the benchmark's in a join (broadcast while the set is proven small),
hits are verified word by word, and only hits are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, kept, lookup, row_key, shuffled, whole, whole_rows

WINDOW = 10
# Between words: ASCII that is neither a digit nor a lower-case letter, after lower-casing.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str) -> Column:
    """Lower-cased words; none for a null or empty text."""
    parts = F.split(ascii_lower(whole(text)), _BETWEEN, -1)
    # Only what stands before the first and behind the last word can be empty.
    first = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    empty_end = F.when((F.size(parts) >= first) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return F.slice(parts, first, F.greatest(F.size(parts) - first + 1 - empty_end, F.lit(0)))


def _windows(all_words: Column, size: int) -> Column:
    """A window's words for each place it can begin."""
    return F.transform(
        F.when(F.size(all_words) >= size, F.sequence(F.lit(1), F.size(all_words) - (size - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.slice(all_words, i, size),
    )


def _window_hash(hashes: Column, at: Column, size: Column, sizes: list[int]) -> Column:
    """Hash of the hashes of the ``size`` words from place ``at`` (from 0); null where they do not fit."""
    found = F.lit(None).cast("long")
    for n in sizes:
        found = F.when(size == n, F.xxhash64(*[F.get(hashes, at + k) for k in range(n)])).otherwise(found)
    return F.when(at + size <= F.size(hashes), found)


def benchmark_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(size, gram, first, items): each different window, the hash of its first word, and the items that hold it."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(text).alias("words")).filter(F.size("words") > 0)
    short = F.size("words") < window
    grams = F.when(short, F.array("words")).otherwise(_windows(F.col("words"), window))
    return (
        items.select("item", F.explode(grams).alias("gram"))
        .groupBy(F.size("gram").alias("size"), "gram").agg(F.collect_set("item").alias("items"))
        .withColumn("first", F.xxhash64(F.get("gram", F.lit(0))))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, row_key, n_words, hit_words, items).

    ``hit_words`` are the places (from 1) of words inside any occurrence of a
    benchmark window, ascending; ``items`` the ids, as sorted strings, of the items
    whose windows occur.  Items of fewer words than ``window`` are one window; null,
    empty and wordless items have none, and a null item id is not listed.  Null and
    wordless texts have no hits.  Rows with the same id and text have the same result
    and each keep their row; a null id is an id.  Only the named columns are read.
    """
    known = kept(benchmark_windows(benchmark, window, item_id, item_text), "benchmark")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most ``window`` numbers
    texts = docs.select(
        F.col(doc_id).alias("_id"), row_key(doc_id, text).alias("row_key"), words(text).alias("_words")
    )
    hits = None
    if sizes:
        # Each word is hashed once.  A window counts only where a first word of the benchmark's stands,
        # and its hash is made from those of its words.
        hashes = F.transform("_words", lambda w: F.xxhash64(w))
        # The outer form, as for the other one Spark adds a filter that makes all hashes a second time.
        places = texts.select("row_key", "_words", hashes.alias("_hashes")).select(
            "row_key", "_words", "_hashes", F.posexplode_outer("_hashes").alias("_at", "first")
        )
        firsts = known.select("first").distinct()
        begun = places.join(lookup(firsts, F.lit(16)), "first", "left_semi").select(
            "row_key", "_words", "_hashes", "_at", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")
        ).withColumn("hash", _window_hash(F.col("_hashes"), F.col("_at"), F.col("size"), sizes))
        own = F.transform("gram", lambda w: F.xxhash64(w))
        wanted = known.select("size", "gram", "items", _window_hash(own, F.lit(0), F.col("size"), sizes).alias("hash"))
        bounded = lookup(wanted, 2 * F.octet_length(F.array_join("gram", " ")) + 2 * F.octet_length(F.array_join("items", " ")) + 300)
        same = shuffled(begun).join(bounded, ["hash", "size"]).filter(F.slice("_words", F.col("_at") + 1, F.col("size")) == F.col("gram"))
        hits = same.select("row_key", "_at", F.col("size").alias("_size"), "items")
    rows = texts.select("_id", "row_key", F.size("_words").cast("long").alias("n_words"))
    if hits is None:
        none = F.array().cast("array<int>"), F.array().cast("array<string>")
        return rows.select(F.col("_id").alias(doc_id), "row_key", "n_words", none[0].alias("hit_words"), none[1].alias("items"))
    per_row = hits.groupBy("row_key").agg(
        F.collect_set(F.struct("_at", "_size")).alias("_places"), F.collect_set("items").alias("_items")
    ).select(
        "row_key",
        F.array_sort(F.array_distinct(F.flatten(F.transform(
            "_places", lambda p: F.sequence(p["_at"] + 1, p["_at"] + p["_size"])
        )))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"),
    )
    return rows.join(per_row, "row_key", "left").select(
        F.col("_id").alias(doc_id), "row_key", "n_words",
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts and digest of ``contamination`` per row."""
    return contamination(docs, benchmark, **options).select(
        options.get("doc_id", "doc_id"), "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns kept."""
    hit = contamination(docs, benchmark, **options).filter(F.size("hit_words") > 0).select(F.col("row_key").alias("whole_key"))
    rows = whole_rows(docs, options.get("doc_id", "doc_id"), options.get("text", "text"))
    return rows.join(hit, "whole_key", "left_anti").select("whole_row.*")
