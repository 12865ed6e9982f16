"""Merkle manifest of a dataset: a tree of digests per group, and one over the groups' roots.

A level of all trees is one table of nodes (group, place, digest).  Each level joins
itself at the places of a node's siblings, which follow from its own place: the
places of its run, one slot offset after another.  The rows of slot zero then hold
their whole run and emit the parents.  Proofs are put together from the top down,
each level joined to the one above it by the place of the parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_BYTES, kept
from textloom.operators.slices import number_rows

ARITY = 3
# Bytes of a node's row without its proof, and of one step of a proof, both generously.
_NODE_BYTES = 400
# No dataset has more rows, so no tree more levels than this leads to.
_MOST_ROWS = 1 << 50
# A level of at most so many nodes is joined in one task.
_ONE_TASK = 1 << 14
_STEP = "struct<before:string,after:string>"
_PROOF = f"array<{_STEP}>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 length, a colon, itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: no two different lists of values are written alike."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda below, step: F.sha2(F.concat(step["before"], below, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings of a proof, from the bottom up."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def group_key(group: Column) -> Column:
    """The group as a text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _small(nodes: DataFrame, n_nodes: int, row_bytes: int) -> DataFrame:
    """With a broadcast hint if the number of nodes, which is known exactly, allows it."""
    return F.broadcast(nodes) if n_nodes * row_bytes <= BROADCAST_BYTES // 4 else nodes


class Tree:
    """The levels of the trees of all groups.

    ``leaves`` has ``grp``, ``place`` (from 0 in its group), ``n`` (leaves of the
    group), ``digest`` and any ``extras``, and is read more than once.  Level k is
    written once, by one job: ``grp, place, n`` (nodes of the group on this level),
    ``digest, before, after`` (the siblings' digests) and on level 0 the extras.
    Only groups that still have several nodes take part in a level.
    """

    def __init__(self, leaves: DataFrame, arity: int = ARITY, extras: Sequence[str] = ()):
        if arity < 2:
            raise ValueError(f"a run needs two nodes at least; {arity} are none")
        self.arity, self.extras, self.leaves = arity, list(extras), leaves
        self.sizes = self._sizes(leaves)
        self.levels: list[DataFrame] = []
        nodes = leaves
        for n_nodes in self.sizes:
            level = kept(self._linked(nodes.where("n > 1"), n_nodes), "merkle")
            self.levels.append(level)
            nodes = self._parents(level)

    def _sizes(self, leaves: DataFrame) -> list[int]:
        """How many nodes take part in each level; one row per group is counted."""
        powers = [1]
        while powers[-1] < _MOST_ROWS:
            powers.append(powers[-1] * self.arity)
        widths = [F.ceil(F.col("n") / F.lit(p)) for p in powers]
        groups = leaves.where("place = 0").select("n")
        self.n_groups, *sizes = groups.agg(F.count(F.lit(1)), *[F.sum(F.when(w > 1, w).otherwise(0)) for w in widths]).first()
        return [n for n in sizes if n]

    def _linked(self, nodes: DataFrame, n_nodes: int) -> DataFrame:
        """Each node beside its siblings: one equality join for each slot offset."""
        arity = self.arity
        slot, run = F.col("place") % arity, F.col("place") - F.col("place") % arity
        if n_nodes <= _ONE_TASK:
            nodes = nodes.coalesce(1)
        out = nodes
        for offset in range(1, arity):
            sibling = _small(nodes.select("grp", F.col("place").alias("_at"), F.col("digest").alias(f"_s{offset}")), n_nodes, _NODE_BYTES)
            out = out.withColumn("_at", run + (slot + offset) % arity).join(sibling, ["grp", "_at"], "left").drop("_at")

        # The sibling at slot s lies (s - slot) mod arity further on; those that wrap round stand before the node.
        def joined(wraps: bool) -> Column:
            offsets = range(1, arity)
            parts = [
                F.when(((slot + o) >= arity) if wraps else ((slot + o) < arity), F.coalesce(F.col(f"_s{o}"), F.lit(""))).otherwise("")
                for o in offsets
            ]
            return F.concat(*parts)

        kept_extras = [c for c in self.extras if c in nodes.columns]
        return out.select("grp", "place", "n", "digest", joined(True).alias("before"), joined(False).alias("after"), *kept_extras)

    def _parents(self, level: DataFrame) -> DataFrame:
        return level.where(F.col("place") % self.arity == 0).select(
            "grp", F.floor(F.col("place") / self.arity).alias("place"), F.ceil(F.col("n") / self.arity).alias("n"),
            F.sha2(F.concat("digest", "after"), 256).alias("digest"),
        )

    def tops(self) -> DataFrame:
        """(grp, depth, digest): the root of each group's tree."""
        found = self.leaves.where("n = 1").select("grp", F.lit(0).alias("depth"), "digest")
        for k, level in enumerate(self.levels):
            found = found.unionByName(self._parents(level).where("n = 1").select("grp", F.lit(k + 1).alias("depth"), "digest"))
        return found

    def proofs(self, tops: DataFrame, carried: Sequence[str], steps_above: int) -> DataFrame:
        """The leaves with ``proof``, the siblings from the leaf to the top of ``tops``, and the ``carried`` columns.

        ``tops`` has (grp, depth, proof) and the carried columns, which every leaf of
        its group gets: ``proof`` there leads on from the top, by ``steps_above`` steps at most.
        """
        def of_depth(k: int) -> DataFrame:
            return tops.where(F.col("depth") == k).select("grp", F.lit(0).cast("bigint").alias("place"), "proof", *carried)

        below = of_depth(len(self.levels))
        n_below = 0
        for k in reversed(range(len(self.levels))):
            steps = steps_above + len(self.levels) - k
            above = _small(
                below.select("grp", F.col("place").alias("_up"), "proof", *carried), n_below + self.n_groups, _NODE_BYTES + 150 * self.arity * steps
            )
            step = F.struct("before", "after").cast(_STEP)
            own = self.levels[k].withColumn("_up", F.floor(F.col("place") / self.arity)).join(above, ["grp", "_up"])
            extras = self.extras if k == 0 else []
            below = own.select("grp", "place", F.concat(F.array(step), "proof").alias("proof"), *carried, *(["digest"] if k == 0 else []), *extras)
            n_below = self.sizes[k]
            if k:
                below = below.unionByName(of_depth(k))
        alone = self.leaves.where("n = 1").join(tops.where("depth = 0").select("grp", "proof", *carried), "grp")
        alone = alone.select("grp", "place", "proof", *carried, "digest", *self.extras)
        return below.unionByName(alone) if self.levels else alone


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``place`` from 0 in each ``grp`` and ``n``, the rows of the group; written once."""
    placed = number_rows(rows, ["grp"], order, "place").withColumn("place", F.col("place") - 1)
    counts = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return kept(placed.join(counts, "grp"), "merkle-leaves")


def manifest(
    docs: DataFrame, columns: Sequence[str], *, group: str, order: Sequence[str], arity: int = ARITY, extras: dict[str, Column] | None = None
) -> DataFrame:
    """Per row its place in a Merkle tree of the dataset: ``leaf, subroot, root, proof`` and the ``extras``.

    A leaf is the digest of ``columns``; leaves of a ``group`` ascend by the columns of
    ``order`` (null first), and the groups' roots by their group as text (null first, by
    bytes).  While several nodes remain, each run of ``arity`` becomes its parent, a last
    run of one node too.  ``proof`` lists for each level what stands before and after
    the node, from the leaf to the root.  Null groups are one group.  Rows equal in all
    of ``columns`` are leaves of their own, whose order does not matter.  An empty table gives no
    rows.  Only the named columns are read, the text once; from then on a row is its
    digest, so a text's length does not matter, and groups of any size spread over all tasks.
    """
    extras = extras or {}
    names = [f"_x{i}" for i in range(len(extras))]
    rows = docs.select(
        group_key(F.col(group)).alias("grp"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        leaf([F.col(c) for c in columns]).alias("digest"), *[e.alias(n) for e, n in zip(extras.values(), names)],
    )
    rows = kept(rows, "merkle-rows")
    by = [F.asc_nulls_first(f"_o{i}") for i in range(len(order))]
    leaves = numbered(rows, [*by, F.asc("digest")]).drop(*[f"_o{i}" for i in range(len(order))])
    trees = Tree(leaves, arity, names)
    tops = kept(trees.tops(), "merkle-tops")
    # The trees' roots are the leaves of the last tree, whose only group is the empty text (a column, so that joins keep their key).
    roots = numbered(tops.select(F.substring("grp", 1, 0).alias("grp"), F.col("grp").alias("_of"), "depth", "digest"), [F.asc("_of")])
    last = Tree(roots, arity, ["_of", "depth"])
    end = last.tops().withColumn("proof", F.array().cast(_PROOF)).withColumnRenamed("digest", "root")
    over = kept(
        last.proofs(end, ["root"], 0).select(F.col("_of").alias("grp"), "depth", F.col("digest").alias("subroot"), "root", "proof"), "merkle-tops"
    )
    found = trees.proofs(over, ["subroot", "root"], len(last.levels))
    return found.select(
        F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(n).alias(name) for n, name in zip(names, extras)]
    )


def manifest_digest(docs: DataFrame) -> DataFrame:
    """Per document its leaf, roots, the digest of its proof, and whether a possibly damaged copy still verifies.

    The copy of a document whose id has an even CRC-32 has lost its newlines.  A null
    id or text is never damaged.
    """
    damaged = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    text = F.when(damaged, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    copy = leaf([F.col(c) for c in columns[:-1]] + [text])
    found = manifest(docs, columns, group="source", order=["doc_id"], extras={"doc_id": F.col("doc_id"), "copy": copy})
    rooted = found.withColumn("folded_root", fold(F.col("copy"), F.col("proof")))
    return rooted.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
