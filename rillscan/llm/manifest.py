"""A Merkle manifest of a dataset that stores every few levels and regenerates the others.

The rows of each group (a source) are the leaves of a tree in which ``arity`` neighbours become one
node; the roots of the groups are the leaves of one more tree.  Only the leaves and every
``every``-th level above them are stored.  A node of a stored level roots an aligned subtree over the stored
level below, of at most arity ** every nodes.  For proofs those meet once more, with the path from
their subtree's root upwards; the levels between are hashed again, give each node its
siblings, and are gone with the task.

A group of any size is many subtrees, so no task sees more than one subtree at a time.  Texts are
hashed where they are read, and only digests move.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

PATH = "array<struct<at:int,others:string>>"
_PATH = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))


def digest(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of the values in a row: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    def value(c):
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns)), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


@dataclass(frozen=True)
class Shape:
    """How many neighbours make a node, and how many levels lie from one stored level to the next."""
    arity: int = 16
    every: int = 3

    @property
    def span(self) -> int:
        return self.arity ** self.every

    def levels(self, nodes: list[str], whole: bool) -> list[list[list[str]]]:
        """The runs of each level that a subtree regenerates from its stored nodes.  ``whole``: the
        subtree is all that is left of its tree, which ends as soon as there is one node."""
        out = []
        for _ in range(self.every):
            if whole and len(nodes) == 1:
                break
            out.append([nodes[i:i + self.arity] for i in range(0, len(nodes), self.arity)])
            nodes = [_hash(run) for run in out[-1]]
        return out

    def _ordered(self, table: pa.Table) -> tuple[pa.Table, list[str], bool]:
        table = table.sort_by("idx")
        return table, table.column("digest").to_pylist(), table.column("nodes")[0].as_py() <= self.span

    def parent(self, table: pa.Table) -> pa.Table:
        """The root of a subtree."""
        table, nodes, whole = self._ordered(table)
        top = _hash(self.levels(nodes, whole)[-1][0])
        idx = table.column("idx")[0].as_py() // self.span
        return pa.table({"tree": table.column("tree")[:1], "idx": pa.array([idx], pa.int64()), "digest": pa.array([top])})

    def with_paths(self, nodes: pa.Table, above: pa.Table) -> pa.Table:
        """The stored nodes of a subtree with the siblings of each level up to the root of all."""
        nodes, digests, whole = self._ordered(nodes)
        levels, upper = self.levels(digests, whole), above.column("path")[0].as_py()
        paths = []
        for at in range(len(digests)):
            path = []
            for runs in levels:
                at, place = divmod(at, self.arity)
                run = runs[at]
                path.append({"at": place, "others": "".join(run[:place] + run[place + 1:])})
            paths.append(path + upper)
        subroot = [above.column("subroot")[0].as_py()] * len(digests)
        return nodes.append_column("path", pa.array(paths, _PATH)).append_column("subroot", pa.array(subroot, pa.string()))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, from 0 without gaps in each ``tree``.  The rows are sorted over the cluster; what a
    partition holds of a tree starts where the partitions before it end."""
    at = written(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                 .withColumn("row_at", F.monotonically_increasing_id())
                 .withColumn("part", F.shiftright("row_at", 33)))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("tree", "part").agg(F.min("row_at").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return at.join(starts, ["tree", "part"]).withColumn("idx", F.col("row_at") + F.col("shift")).drop(
        "row_at", "part", "shift")


@dataclass
class Forest:
    """Trees by name.  ``stored[k]`` has the nodes ``tree, idx, digest, nodes`` of level k * every, of the trees
    that have several there (``nodes``); ``stored[0]`` has all leaves and their other columns."""
    stored: list[DataFrame]
    roots: DataFrame  # tree, digest, n (leaves)
    shape: Shape

    @staticmethod
    def over(rows: DataFrame, order: list[str], shape: Shape) -> Forest:
        """``rows``: stored, with ``tree, digest`` and more."""
        leaves = _numbered(rows, order)
        counts = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"))
        leaves = written(leaves.join(counts, "tree"))
        stored, roots = [leaves], leaves.where("nodes = 1").select("tree", "digest", F.lit(1).cast("long").alias("n"))
        counts = written(counts.withColumn("n", F.col("nodes")))
        level = leaves.where("nodes > 1").select("tree", "idx", "digest", "nodes")
        while not level.isEmpty():  # with each step a node covers as many times more
            block = F.floor(F.col("idx") / shape.span).alias("block")
            up = level.groupBy("tree", block).applyInArrow(lambda t: shape.parent(t), "tree string, idx long, digest string")
            counts = counts.withColumn("nodes", F.ceil(F.col("nodes") / shape.span))
            up = written(up.join(counts, "tree"))
            roots = roots.union(up.where("nodes = 1").select("tree", "digest", "n"))
            level = up.where("nodes > 1").drop("n")
            stored.append(level)
        return Forest(stored, written(roots), shape)

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path``, from the leaf up, and ``subroot``.  ``above`` goes on from the root of each
        tree: ``tree, path``."""
        tops = self.roots.select("tree", "n", F.col("digest").alias("subroot")).join(above, "tree")
        upper, span = None, self.shape.span
        for k in range(len(self.stored) - 1, -1, -1):
            nodes = self.stored[k].where("nodes > 1")
            # trees of which this is the last stored level
            ends = (F.col("n") > span ** k) & (F.col("n") <= min(span ** (k + 1), (1 << 63) - 1))
            own = tops.where(ends).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
            upper = own if upper is None else own.union(
                upper.select("tree", F.col("idx").alias("block"), "path", "subroot"))
            shape = self.shape
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
            upper = nodes.groupBy("tree", F.floor(F.col("idx") / span).alias("block")).cogroup(
                upper.groupBy("tree", "block")).applyInArrow(
                lambda t, up: shape.with_paths(t, up), f"{kinds}, path {PATH}, subroot string")
        lone = self.stored[0].where("nodes = 1").join(tops.select("tree", "path", "subroot"), "tree")
        return upper.unionByName(lone)


@dataclass
class Manifest:
    groups: Forest
    over: Forest
    """The tree whose leaves are the roots of the groups."""

    @property
    def root(self) -> DataFrame:
        """One row, ``digest``; none if there are no rows."""
        return self.over.roots.select("digest")


def build(docs: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id",
          keep: dict[str, Column] | None = None, shape: Shape | None = None) -> Manifest:
    """The manifest of ``docs``: a leaf is the digest of ``columns`` in their order.

    Leaves ascend by ``order`` in their group (null first); rows that are equal there go by their
    digest, and equal digests may change places.  Groups ascend by their UTF-8 bytes, null first.  ``keep``
    names what else the leaves carry.  Null and empty values have different digests.  An empty table
    has a manifest without a root.  Columns that are not named are not read.
    """
    shape = shape or Shape()
    rows = written(docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("place"), digest(*[F.col(c) for c in columns]).alias("digest"),
        F.monotonically_increasing_id().alias("spread"), *[c.alias(f"kept_{k}") for k, c in (keep or {}).items()]))
    groups = Forest.over(rows, ["place", "digest", "spread"], shape)
    over = Forest.over(written(groups.roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("place"), "digest")), ["place"], shape)
    return Manifest(groups, over)


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf: ``place`` (its value of ``order``), ``leaf, subroot, root, path`` and the kept columns.

    ``path`` has a step for each level, from the leaf to the root: the siblings (others of the run, left to
    right, 64 digits each) and the node's place before, between or after them.
    """
    top = manifest.over.roots.select("tree", F.array().cast(PATH).alias("path"))
    groups = manifest.over.paths(top).select(F.col("place").alias("tree"), "path")
    leaves = manifest.groups.paths(written(groups))
    root = manifest.root.first()
    return leaves.select(
        "place", F.col("digest").alias("leaf"), "subroot", F.lit(root and root[0]).cast("string").alias("root"), "path",
        *[F.col(c).alias(c.removeprefix("kept_")) for c in leaves.columns if c.startswith("kept_")])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    def step(node, level):
        cut = 64 * level["at"]
        return F.sha2(F.concat(F.substr(level["others"], F.lit(1), cut), node,
                               F.substr(level["others"], cut + 1)), 256)
    return F.aggregate(path, leaf, step)


def path_digest(path: Column) -> Column:
    """SHA-256 of the siblings of all levels in a row."""
    return F.sha2(F.array_join(F.transform(path, lambda level: level["others"]), ""), 256)
