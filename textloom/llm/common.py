"""What the operators of this package share: tables, kept results, row keys, digests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Above this many bytes a lookup table is joined by shuffle instead of broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back.

    Cuts the lineage: a lost executor costs a read, not the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str) -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(doc_id: str, text: str) -> Column:
    """Equal for rows that must get equal results: same id (null included) and same text."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), whole(text)))


def lookup(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` with a broadcast hint if the sum of ``row_bytes`` over its rows allows it."""
    size = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with the hint to join it by shuffle, unless the other side is hinted to be broadcast.

    For rows that grow with the corpus: Spark takes exploded rows to be as large as what
    they were made of, and a file's rows as large as the compressed file, so it may try
    to send them to the driver.
    """
    return df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Few rows in an Arrow batch, since a text or its hashes may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def whole_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(whole_row, whole_key): all columns as one, so that no name of theirs can clash, and the row key."""
    return docs.select(F.struct(*docs.columns).alias("whole_row"), row_key(doc_id, text).alias("whole_key"))
