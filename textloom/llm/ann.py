"""Approximate nearest neighbours by multi-index hashing.

Learned rotations turn a vector into a binary code.  The code is cut into bytes, and
each byte is an index of its own.  A code within ``radius`` bits of the query's has
a byte within ``radius // bytes`` bits of the query's byte (pigeonhole), so probing
the indexes with those values retrieves every code within the radius.  The retrieved
vectors are ranked by their true distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import kept

# Rows the rotations and the radius are learned from at most, those of least id hash.
SAMPLE = 4096
ROTATIONS = 2
ITERATIONS = 25
# Share of the sample's true neighbours that the radius must reach.  Neighbours in all
# rows lie closer than in a sample, so the recall over all rows is higher.
SAMPLE_RECALL = 0.97
SAMPLE_QUERIES = 256
# A unit of work is a block of rows and a block of queries.
ROW_BLOCK, QUERY_BLOCK = 8192, 8192


@dataclass
class Coder:
    """Mean, rotations (dimension x bits) and the radius in bits."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)


def learn_coder(sample: np.ndarray, neighbours: int, seed: int = 0) -> Coder:
    """Rotations that bring principal components close to the corners of a cube, and the radius they need."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned = centred @ axes
    turns = []
    for number in range(ROTATIONS):
        turn = np.linalg.qr(np.random.default_rng(seed + number).normal(size=axes.shape))[0]
        for _ in range(ITERATIONS):
            left, _, right = np.linalg.svd(np.where(turned @ turn > 0, 1.0, -1.0).T @ turned)
            turn = (left @ right).T
        turns.append(axes @ turn)
    coder = Coder(mean, np.concatenate(turns, axis=1), 0)
    codes = coder.codes(sample)
    bits = []
    for i in range(min(SAMPLE_QUERIES, len(sample))):
        far = ((sample - sample[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[:min(neighbours, len(sample) - 1)]
        bits.append(np.bitwise_count(codes[near] ^ codes[i]).sum(axis=1))
    reached = np.concatenate(bits)
    coder.radius = int(np.quantile(reached, SAMPLE_RECALL, method="higher")) if len(reached) else 0
    return coder


class ByteIndexes:
    """For each byte of the codes the rows by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, b], kind="stable") for b in range(codes.shape[1])]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, b], minlength=256))]) for b in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits."""
        least = radius // len(code)
        values = np.arange(256, dtype=np.uint8)
        met = np.zeros(len(self.codes), dtype=bool)
        for b in range(len(code)):
            probes = np.flatnonzero(np.bitwise_count(values ^ code[b]) <= least)
            begin, size = self.start[b][probes], np.diff(self.start[b])[probes]
            places = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            met[self.order[b][places]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _usable(vector: Column) -> Column:
    return (
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def nearest(
    rows: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", neighbours: int = 10
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row where ``is_query`` holds.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller
    id.  A row is no neighbour of its own id.  Null ids, and vectors that are null,
    empty, zero, or hold null or non-finite components, take no part; nor do vectors
    of another length than most (of equally frequent lengths the longest counts).
    Of rows with one id the one with the least vector counts.  A query for which a
    block holds fewer codes within the radius than asked for takes all of the block,
    so it gets ``neighbours`` rows wherever there are as many.  Only the named
    columns are read; an empty table gives an empty table.
    """
    schema = "query_id long, vec_id long, score double"
    given = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks")
    ).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    usable = kept(given.filter(_usable(F.col("vector"))), "vectors")
    sizes = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = usable.filter(F.size("vector") == sizes["size"]).groupBy("vec_id").agg(
        F.min("vector").alias("vector"), F.max("asks").alias("asks")
    )
    # The rows of least hash: a bounded sample that does not depend on the partitions.
    sample = usable.filter(F.size("vector") == sizes["size"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    coder = learn_coder(np.stack(sample.select("vector").toPandas()["vector"].to_numpy()), neighbours)

    def blocks(n: int, size: int) -> int:
        return max(1, -(-n // size))

    row_blocks = blocks(sizes["count"], ROW_BLOCK)
    query_blocks = blocks(usable.filter("asks").count(), QUERY_BLOCK)
    place = F.xxhash64("vec_id")
    every_query_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    every_row_block = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    stored = vectors.select(
        F.pmod(place, F.lit(row_blocks)).cast("int").alias("row_block"), every_query_block.alias("query_block"), "vec_id", "vector"
    )
    asked = vectors.filter("asks").select(
        every_row_block.alias("row_block"), F.pmod(place, F.lit(query_blocks)).cast("int").alias("query_block"), "vec_id", "vector"
    )

    def search(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        points, ids = np.stack(held["vector"].to_numpy()), held["vec_id"].to_numpy()
        asks, names = np.stack(queries["vector"].to_numpy()), queries["vec_id"].to_numpy()
        index, codes = ByteIndexes(coder.codes(points)), coder.codes(asks)
        out = []
        for i, name in enumerate(names):
            met = index.within(codes[i], coder.radius)
            met = met[ids[met] != name]
            if len(met) < neighbours:
                met = np.flatnonzero(ids != name)
            score = np.sqrt(((points[met] - asks[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[met], score))[:neighbours]
            out.append(pd.DataFrame({"query_id": name, "vec_id": ids[met][best], "score": score[best]}))
        return pd.concat(out)

    found = asked.groupBy("row_block", "query_block").cogroup(stored.groupBy("row_block", "query_block")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours).select(
        "query_id", "rank", "vec_id", "score"
    )
