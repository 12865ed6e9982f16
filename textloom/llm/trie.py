"""Prefix trie of conversations: every distinct beginning is a node.

Conversations become rows of turn ids, range-partitioned in the order of those rows.
A shard pads its rows to a matrix, sorts it, and marks with one accumulated
comparison of neighbours where the nodes of every depth start; sums over the marked
stretches give the nodes.  What a shard cannot finish alone is a node that holds its
first or its last row, or that goes on in a later stretch of columns: those few
nodes are met by key, and their subtrees added up over doubled steps to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_BYTES, kept, small_batches
from textloom.operators.slices import number_rows, range_slices

# A row of the matrices holds so many turns; longer conversations have several rows.
WIDTH = 128
# A shard holds about so many rows.
SHARD_ROWS = 1 << 15
_ID = 16
# So many conversation numbers make one row of what is hashed in the end.
_ENDS_AT_ONCE = 4096
# Bytes of an open node's row, generously.
_PART_BYTES = 200
_WORD = r"[^\x20\x09-\x0D]+"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_KEY = ["depth", "key_a", "key_b"]
_FOUND = (
    "kind string, depth long, key_a long, key_b long, up_a long, up_b long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, words long, ends string"
)


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that name a turn: equal for equal role and text only."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _ID)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn, words) per turn, ``at`` from 0 in the order of the conversation.

    Null role or text counts as empty, a null turn comes first, and equal turn numbers
    are ordered by the turn's id.  Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    bare = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), turn_id(role, text).alias("turn"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    ordered = number_rows(kept(bare, "turns"), ["conv_id"], [F.asc_nulls_first("_turn"), F.asc("turn")], "at")
    return ordered.select("conv_id", (F.col("at") - 1).alias("at"), "turn", "words")


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """The turns of every conversation rebuilt on the beginning of the first of its block.

    Conversation c gets the first h turns of c - c % ``block``, h being its CRC-32
    modulo ``heads``, and its own turns after its first h.  Those that end up without any
    turn have one row with ``at`` null.
    """
    convs = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads)
    convs = kept(convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block), "conversations")
    # A base has fewer than ``heads`` turns to give and at most 2 * block - 1 takers.
    first = turns.where((F.col("at") < heads - 1) & (F.col("conv_id") % block == 0)).select(
        F.col("conv_id").alias("base"), "at", "turn", "words"
    )
    given = convs.join(first, "base").where(F.col("at") < F.col("h")).select("conv_id", "at", "turn", "words")
    given = kept(given, "heads")
    # Where the base has less than h turns, the conversation's own ones move up.
    gaps = convs.join(given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_got")), "conv_id", "left").select(
        "conv_id", (F.col("h") - F.coalesce("_got", F.lit(0))).alias("_gap")
    ).where("_gap > 0")
    own = turns.where(F.col("at") >= F.crc32(F.col("conv_id").cast("string")) % heads)
    own = own.join(gaps, "conv_id", "left").select("conv_id", (F.col("at") - F.coalesce("_gap", F.lit(0))).alias("at"), "turn", "words")
    every = convs.select("conv_id", F.lit(None).cast("long").alias("at"), F.lit("").alias("turn"), F.lit(0).cast("long").alias("words"))
    return every.unionByName(given).unionByName(own)


def stretches(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv_id, stretch, pre_a, pre_b, ids, words, more) per ``width`` turns of a conversation.

    ``ids`` are the turns' ids one after another; ``pre_a, pre_b`` name all that comes
    before, so rows agree in them if they agree in every earlier turn.  Every
    conversation has a stretch 0; ``more`` says whether another one follows.
    """
    parts = turns.groupBy("conv_id", F.floor(F.coalesce("at", F.lit(0)) / width).alias("stretch")).agg(
        F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "turn", "words")))).alias("_t")
    )
    parts = kept(parts.select(
        "conv_id", "stretch", F.unhex(F.array_join("_t.turn", "")).alias("ids"), F.col("_t.words").alias("words")
    ), "stretches")
    full = parts.where(F.size("words") == width)
    if full.isEmpty():
        return parts.withColumns({"pre_a": F.lit(0).cast("long"), "pre_b": F.lit(0).cast("long"), "more": F.lit(False)})
    follows = parts.where("stretch > 0").select("conv_id", (F.col("stretch") - 1).alias("stretch"), F.lit(True).alias("more"))
    # A running sum without carries over the digests of the full stretches before.
    digest = F.sha2(F.concat(F.col("stretch").cast("string"), F.lit(":"), F.hex("ids")), 256)
    halves = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(2)]
    rows = full.select("conv_id", "stretch", halves[0].alias("_a"), halves[1].alias("_b"))
    sliced = range_slices(rows, ["conv_id"], [F.asc("stretch")])
    earlier = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("conv_id", "_slice").agg(F.bit_xor("_a").alias("_sa"), F.bit_xor("_b").alias("_sb")).select(
        "conv_id", "_slice", *[F.coalesce(F.bit_xor(f"_s{x}").over(earlier), F.lit(0)).alias(f"_o{x}") for x in "ab"]
    )
    here = Window.partitionBy("conv_id", "_slice").orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sliced.select("*", *[F.bit_xor(f"_{x}").over(here).alias(f"_i{x}") for x in "ab"]).join(sums, ["conv_id", "_slice"])
    before = running.select(
        "conv_id", (F.col("stretch") + 1).alias("stretch"), *[F.col(f"_i{x}").bitwiseXOR(F.col(f"_o{x}")).alias(f"pre_{x}") for x in "ab"]
    )
    named = parts.join(before, ["conv_id", "stretch"], "left").join(follows, ["conv_id", "stretch"], "left")
    return kept(named.fillna({"pre_a": 0, "pre_b": 0, "more": False}), "stretches")


def _digest_halves(stretch: int, ids: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(f"{stretch}:{ids.hex().upper()}".encode()).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)


class Shard:
    """The nodes of some rows of one stretch, as columns of ``_FOUND``."""

    def __init__(self, stretch: int, width: int, conv: np.ndarray, pre_a: np.ndarray, pre_b: np.ndarray, ids: list[bytes], words: np.ndarray, more: np.ndarray):
        self.stretch, self.width = stretch, width
        lengths = np.array([len(x) // _ID for x in ids])
        n, deep = len(ids), int(lengths.max(initial=0))
        held = np.arange(deep) < lengths[:, None]
        names, ranks = np.unique(np.frombuffer(b"".join(ids), dtype=f"S{_ID}"), return_inverse=True)
        matrix = np.full((n, deep), -1, dtype=np.int64)
        matrix[held] = ranks
        counts = np.zeros((n, deep), dtype=np.int64)
        counts[held] = words
        # The order of the range partitions.  Rows that end in a node come before those that go on, by conversation.
        order = np.lexsort((conv, more, *matrix.T[::-1], pre_b, pre_a))
        self.matrix, self.counts, self.lengths = matrix[order], counts[order], lengths[order]
        self.conv, self.more, self.pre_a, self.pre_b = conv[order], more[order], pre_a[order], pre_b[order]
        self.ids = [ids[i] for i in order]
        self.out: dict[str, list] = {f.split()[0]: [] for f in _FOUND.split(", ")}

    def key(self, row: int, depth: int) -> tuple[int, int]:
        """Name of the node of the first ``depth`` columns of a row; the same in every shard."""
        if not depth:
            return int(self.pre_a[row]), int(self.pre_b[row])
        a, b = _digest_halves(self.stretch, self.ids[row][:_ID * depth])
        return a ^ int(self.pre_a[row]), b ^ int(self.pre_b[row])

    def emit(self, **columns) -> None:
        for name, values in self.out.items():
            values.append(columns.get(name))

    def nodes(self) -> dict[str, list]:
        n, deep = self.matrix.shape
        # changed[i, d]: row i differs from the one before in the first d columns.
        differs = np.ones((n, deep + 1), dtype=bool)
        differs[1:, 0] = (np.diff(self.pre_a) != 0) | (np.diff(self.pre_b) != 0)
        differs[1:, 1:] = self.matrix[1:] != self.matrix[:-1]
        changed = np.logical_or.accumulate(differs, axis=1)
        leaves, saved = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        children = np.zeros(n, dtype=np.int64)
        waiting: list[tuple[int, dict]] = []
        for depth in range(deep, -1, -1):
            at = np.flatnonzero(changed[:, depth])
            there = self.lengths[at] >= depth
            stop = np.append(at[1:], n)
            size = stop - at
            least = np.minimum.reduceat(self.conv, at)
            open_ = np.logical_or.reduceat(self.more, at) | (at == 0) | (stop == n) | (depth == 0)
            n_children = np.add.reduceat(children, at)
            # A row that ends here comes before those that go on.
            ended = np.add.reduceat((self.lengths == depth) & ~self.more, at)
            done = there & ~open_
            words = self.counts[at, depth - 1] if depth else np.zeros(len(at), dtype=np.int64)
            below_leaves, below_saved = np.add.reduceat(leaves, at), np.add.reduceat(saved, at)
            all_leaves = below_leaves + (n_children == 0)
            all_saved = below_saved + (size - 1) * words
            self._attach(waiting, at, open_, least, depth)
            waiting = []
            for i in np.flatnonzero(done).tolist():
                first, last = int(at[i]), int(at[i] + ended[i])
                ends = hashlib.sha256(",".join(map(str, self.conv[first:last].tolist())).encode()).hexdigest() if last > first else _EMPTY_SHA
                waiting.append((first, dict(
                    kind="node", depth=self.stretch * self.width + depth, conv_id=int(least[i]), n_convs=int(size[i]),
                    n_children=int(n_children[i]), n_leaves=int(all_leaves[i]), saved=int(all_saved[i]), words=0, ends=ends,
                )))
            # Rows of stretch s > 0 share their depth 0 with the full width of the stretch before.
            own = depth > 0 or self.stretch == 0
            for i in np.flatnonzero(there & open_).tolist():
                row, last = int(at[i]), int(at[i] + ended[i])
                a, b = self.key(row, depth)
                up_a, up_b = self.key(row, depth - 1) if depth else (None, None)
                total = self.stretch * self.width + depth
                self.emit(
                    kind="part", depth=total, key_a=a, key_b=b, up_a=up_a, up_b=up_b, conv_id=int(least[i]) if own else None,
                    n_convs=int(size[i]) if own else 0, n_children=int(n_children[i]), n_leaves=int(below_leaves[i]), saved=int(below_saved[i]),
                    words=int(words[i]),
                )
                for first in range(row, last if own else row, _ENDS_AT_ONCE):
                    text = ",".join(map(str, self.conv[first:min(last, first + _ENDS_AT_ONCE)].tolist()))
                    self.emit(kind="ends", depth=total, key_a=a, key_b=b, conv_id=int(self.conv[first]), ends=text)
            # What lies under an open node is its own, not that of the open nodes above.
            cleared = np.repeat(there & open_, size)
            leaves[:], saved[:], children[:] = np.where(cleared, 0, leaves), np.where(cleared, 0, saved), 0
            finished = at[done]
            leaves[finished] += (n_children == 0)[done]
            saved[finished] += ((size - 1) * words)[done]
            children[finished] = 1
        return self.out

    def _attach(self, waiting: list, at: np.ndarray, open_: np.ndarray, least: np.ndarray, depth: int) -> None:
        """Give the finished nodes of the depth below their parents."""
        if not waiting:
            return
        rows = np.array([row for row, _ in waiting])
        parent = np.searchsorted(at, rows, side="right") - 1
        for (row, node), i in zip(waiting, parent.tolist()):
            if open_[i]:
                a, b = self.key(int(at[i]), depth)
                node |= {"up_a": a, "up_b": b}
            else:
                node["parent_conv_id"] = int(least[i])
            self.emit(**node)


def shard_nodes(rows: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes each range of rows holds: finished ones, parts of open ones, and who ends in an open one."""
    shards = max(1, -(-rows.count() // shard_rows))
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        stretch_of = table.column("stretch").to_numpy()
        for stretch in np.unique(stretch_of).tolist():
            own = table.filter(pa.array(stretch_of == stretch)).combine_chunks()
            numbers = [own.column(c).to_numpy() for c in ("conv_id", "pre_a", "pre_b")]
            ids, words = own.column("ids").to_pylist(), own.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            found = Shard(stretch, width, *numbers, ids, words, own.column("more").to_numpy()).nodes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.string() if name in ("kind", "ends") else pa.int64()) for name, values in found.items()], names=list(found)
            )

    dealt = rows.repartitionByRange(shards, "stretch", "pre_a", "pre_b", "ids", "more", "conv_id")
    return dealt.select("stretch", "conv_id", "pre_a", "pre_b", "ids", "words", "more").mapInArrow(run, _FOUND)


def _ends(found: DataFrame) -> DataFrame:
    """(key, ends) of the open nodes in which conversations end: their numbers hashed as a stream, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_KEY, key), ends=digest.hexdigest())])

        for batch in batches:
            for *now, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if now != key:
                    if key is not None:
                        yield result()
                    key, digest = now, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if key is not None:
            yield result()

    chunks = found.where("kind = 'ends'").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").select(*_KEY, "ends")
    return chunks.mapInArrow(run, "depth long, key_a long, key_b long, ends string")


def _open_nodes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The open nodes as parents by their children's key, and themselves: parts met by key, sums over whole subtrees."""
    parts = kept(found.where("kind = 'part'").groupBy(*_KEY).agg(
        *[F.max(c).alias(c) for c in ("up_a", "up_b", "words")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    ), "open-nodes")
    n_parts, deepest = parts.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()

    def side(df: DataFrame) -> DataFrame:
        """One row per open node, broadcast while their number, which is known, allows it."""
        return F.broadcast(df) if n_parts * _PART_BYTES <= BROADCAST_BYTES else df

    open_children = parts.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b")
    ).agg(F.count(F.lit(1)).alias("_open"))
    counted = parts.join(side(open_children), _KEY, "left").withColumn("n_children", F.col("n_children") + F.coalesce("_open", F.lit(0)))
    # In step k a node has the sums of all open nodes less than 2^k below it, and names the one 2^k above it.
    sums = counted.select(
        *_KEY, (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"), "up_a", "up_b",
    )
    step = 1
    while step <= deepest:
        sums = kept(sums, "open-sums")
        above = (F.col("depth") - step).alias("depth")
        more = sums.where(F.col("depth") >= step).groupBy(above, F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved")
        )
        higher = sums.select((F.col("depth") + step).alias("depth"), F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"),
                             F.col("up_a").alias("_next_a"), F.col("up_b").alias("_next_b"))
        sums = sums.join(side(more), _KEY, "left").join(side(higher), ["depth", "up_a", "up_b"], "left").select(
            *_KEY, *[(F.col(c) + F.coalesce(extra, F.lit(0))).alias(c) for c, extra in (("n_leaves", "_leaves"), ("saved", "_saved"))],
            F.col("_next_a").alias("up_a"), F.col("_next_b").alias("up_b"),
        )
        step *= 2
    totals = sums.select(*_KEY, F.col("n_leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    joined = counted.join(totals, _KEY).join(_ends(found), _KEY, "left")
    open_nodes = kept(joined.select(
        *_KEY, "up_a", "up_b", "conv_id", "n_convs", "n_children", F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved"),
        F.coalesce("ends", F.lit(_EMPTY_SHA)).alias("ends"),
    ), "open-nodes")
    parents = open_nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"), F.col("conv_id").alias("_parent")
    )
    return side(parents), open_nodes


def prefix_trie(conversations: DataFrame, *, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations (see ``rebuilt``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (words that need not be processed again, over the subtree)
    and ``ends_sha256`` (the members that end there).  Nulls, ties and rows without a
    conversation as in ``turn_rows``; a long text counts by its words and a digest, a
    long conversation has several rows, and copies of one spread over shards.  An empty
    table has no nodes.  Only conv_id, turn, role and text are read.
    """
    rows = stretches(rebuilt(turn_rows(conversations)), width)
    found = kept(shard_nodes(rows, width, shard_rows), "trie")
    parents, open_nodes = _open_nodes(found)
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    finished = found.where("kind = 'node'").join(parents, ["depth", "up_a", "up_b"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_parent")
    )
    met = open_nodes.join(parents, ["depth", "up_a", "up_b"], "left").withColumn("parent_conv_id", F.col("_parent"))
    return finished.select(columns).unionByName(met.select(columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
