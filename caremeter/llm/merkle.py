"""Merkle manifest of a dataset: digests of rows, folded run by run to one root, with a proof for every row.

Rows are numbered inside their group by a range partitioning and counts per partition, so no group passes through one
task. At every level the slot-zero nodes (first of their run) equijoin their siblings, whose slot-zero index is their
own index less their slot, and emit the parents. Proofs go the other way: a node's path is its siblings before the path
of its parent, joined level by level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caremeter.llm.common import saved

FANOUT = 8
PROOF = ("key", "leaf", "subroot", "root", "path")
PATH = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """``-`` for NULL, else the length in UTF-8 bytes, a colon and the value as text: no two rows of values look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its path."""
    return F.aggregate(path, leaf, lambda own, run: F.sha2(F.concat(run["before"], own, run["after"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf's up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), ""), 256)


@dataclass
class Tree:
    """``leaves`` are (g, n, idx, h, carried columns); ``levels[i]`` the nodes of height i + 1: (g, n, idx, h, run)."""
    leaves: DataFrame
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """The last node of every group: (g, top)."""
        found = [t.where("n = 1").select("g", F.col("h").alias("top")) for t in (self.leaves, *self.levels)]
        out = found[0]
        for t in found[1:]:
            out = out.unionByName(t)
        return out


@dataclass
class Manifest:
    groups: Tree          # one tree for each group of rows
    summit: Tree          # one tree over the groups' subroots
    root: str | None      # None for a table without rows


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with group ``g``) with ``idx``, the place in the group by ``order`` (NULL first), and the group's size ``n``.

    Equal rows are interchangeable; a random last key of the partitioning spreads them.
    """
    spread = rows.repartitionByRange("g", *order, F.rand(11)).sortWithinPartitions("g", *order)
    placed = saved(spread.withColumn("at", F.monotonically_increasing_id())
                   .withColumn("part", F.shiftright("at", 33)), "merkle-order")
    parts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    # these windows run over one row for each group and partition
    before = F.sum("here").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("here").over(Window.partitionBy("g"))
    offsets = parts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), whole.alias("n"))
    return (placed.join(offsets, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift"))
            .drop("at", "part", "shift"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of all groups that have more than one node: slot-zero nodes joined with their siblings.

    Join and aggregation share one partitioning, by group and index of the run's slot-zero node.
    """
    slot = F.col("idx") % FANOUT
    nodes = nodes.where("n > 1").select("g", "n", "h", slot.alias("slot"), (F.col("idx") - slot).alias("zero"))
    first = nodes.where("slot = 0").select("g", "zero", "n", F.col("h").alias("h0"))
    siblings = nodes.where("slot > 0").select("g", "zero", F.struct("slot", "h").alias("sibling"))
    joined = first.join(siblings, ["g", "zero"], "left").groupBy("g", "zero", "n", "h0").agg(F.collect_list("sibling").alias("rest"))
    rest = F.transform(F.array_sort("rest"), lambda s: s["h"])
    return joined.select("g", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.expr(f"zero div {FANOUT}").alias("idx"),
                         F.concat(F.array("h0"), rest).alias("run")).withColumn("h", F.sha2(F.array_join("run", ""), 256))


def grow(leaves: DataFrame) -> Tree:
    """All levels over numbered leaves (g, n, idx, h, ...)."""
    leaves = saved(leaves, "merkle-leaves")
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while largest > 1:
        nodes = saved(parents(nodes), "merkle-level")
        levels.append(nodes)
        largest = -(-largest // FANOUT)
    return Tree(leaves, levels)


def build(df: DataFrame, columns: Sequence[str], group: str = "lang", order: str = "doc_id",
          carry: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``df``: a leaf is the digest of ``columns``, leaves ascend by ``order`` inside each ``group``.

    Runs of eight nodes become their digest until one is left, the group's subroot; subroots, ordered by group (NULL
    first, then by UTF-8 bytes), give the root in the same way. NULLs are part of the digest and differ from empty
    texts. Rows that tie in ``order`` (repeated ids, NULL ids first) are ordered by their digest, repeated rows are
    leaves of their own. A table without rows has no root (None). ``carry`` names columns to keep with each leaf;
    under names that ``prove`` does not use itself; other columns of ``df`` count for nothing unless in ``columns``.
    """
    if taken := set(PROOF) & set(carry or {}):
        raise ValueError(f"cannot carry columns named {sorted(taken)}")
    rows = df.select(framed(F.col(group)).alias("g"), F.col(order).alias("key"),
                     digest(*[F.col(c) for c in columns]).alias("h"),
                     *[c.alias(f"c_{name}") for name, c in (carry or {}).items()])
    groups = grow(numbered(saved(rows, "merkle-rows"), ["key", "h"]))
    name = F.when(F.col("g") != "-", F.expr("substring(g, instr(g, ':') + 1)"))
    subroots = groups.tops().select(F.lit("").alias("g"), name.alias("key"), F.col("top").alias("h"))
    summit = grow(numbered(subroots, ["key"]))
    top = summit.tops().first()
    return Manifest(groups, summit, top["top"] if top else None)


def paths(tree: Tree, onward: DataFrame) -> DataFrame:
    """The leaves of a tree with ``path``: their siblings level by level, then ``onward`` (g, path, ...) of their group.

    Further columns of ``onward`` come with it.
    """
    more = [c for c in onward.columns if c not in ("g", "path")]
    above = None
    for nodes in [*reversed(tree.levels), tree.leaves]:
        own = [c for c in nodes.columns if c not in ("g", "idx", "n")]
        here = nodes.where("n = 1").join(onward, "g")          # the top of its group
        if above is not None:
            slot = (F.col("idx") % FANOUT).cast("int")
            run = F.struct(F.array_join(F.slice("siblings", F.lit(1), slot), "").alias("before"),
                           F.array_join(F.slice("siblings", slot + 2, F.size("siblings")), "").alias("after"))
            up = above.select("g", F.col("idx").alias("up"), F.col("run").alias("siblings"), "path", *more)
            joined = nodes.where("n > 1").withColumn("up", F.expr(f"idx div {FANOUT}")).join(up, ["g", "up"])
            here = here.select("g", "idx", *own, "path", *more).unionByName(joined.select(
                "g", "idx", *own, F.concat(F.array(run), "path").alias("path"), *more))
        above = here
    return above


def prove(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Every leaf with what a holder of the root needs: ``key``, carried columns, ``leaf``, ``subroot``, ``root``, ``path``."""
    summit = spark.createDataFrame([("", [])], f"g string, path {PATH}")
    tops = manifest.groups.tops()
    # one row for each group; a subroot is found by its place, as equal subroots cannot be (their rows tell the group)
    named = manifest.summit.leaves.withColumn("own", framed(F.col("key")))
    onward = paths(Tree(named, manifest.summit.levels), summit).select(F.col("own").alias("g"), "path")
    onward = saved(onward.join(tops, "g").withColumnRenamed("top", "subroot"), "merkle-onward")
    found = paths(manifest.groups, onward)
    carried = [c for c in found.columns if c.startswith("c_")]
    return found.select("key", *[F.col(c).alias(c[2:]) for c in carried], F.col("h").alias("leaf"), "subroot",
                        F.lit(manifest.root).cast("string").alias("root"), "path")


def verify(proofs: DataFrame, claimed: Column) -> Column:
    """Whether a claimed leaf digest leads to the root along a row's path."""
    return fold(claimed, proofs["path"]) == proofs["root"]
