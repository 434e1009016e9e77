"""Fingerprints of tables as hash trees: equal tables have equal roots, and what differs is found by descending.

Rows fall into leaves by the first hex digits of the SHA-256 of their key. A leaf's digest adds up two 60-bit parts of its rows'
SHA-256, so it depends on the rows alone, never on their order or partitions, and repeated rows count. A node above is the SHA-256 of its children's digests in order of
their digit, sixteen at most. Nothing but the tree's nodes is shuffled, and no group is larger than a leaf's partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.storage import cut

DEPTH = 3


def leaf_of(key: Column, depth: int) -> Column:
    """The leaf of a key; null keys share the leaf of the empty text."""
    return F.left(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), F.lit(depth))


def _part(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")


def tree(rows: DataFrame, key: Column, row: Column, depth: int = DEPTH) -> DataFrame:
    """``level, prefix, n, digest``: all nodes that hold rows, level 0 the root. ``row`` is the text of a row; null counts as empty.

    An empty table has no nodes; :func:`root` gives it the digest of nothing. Choose ``depth`` so that 16 ** depth leaves hold a few thousand rows each.
    """
    d = F.sha2(F.coalesce(row, F.lit("")), 256)
    sums = rows.select(leaf_of(key, depth).alias("prefix"), _part(d, 1).alias("a"), _part(d, 16).alias("b")).groupBy("prefix").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    level = cut(sums.select("prefix", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest")), "leaves")
    nodes = level.select(F.lit(depth).alias("level"), "prefix", "n", "digest")
    for at in range(depth - 1, -1, -1):
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat(c["prefix"], F.lit("="), c["digest"])), ";")
        level = level.groupBy(F.left("prefix", F.lit(at)).alias("parent")).agg(F.sum("n").alias("n"), F.sha2(inner, 256).alias("digest")).withColumnRenamed("parent", "prefix").select("prefix", "n", "digest")
        nodes = nodes.unionByName(level.select(F.lit(at).alias("level"), "prefix", "n", "digest"))
    return cut(nodes, "tree")


def root(nodes: DataFrame) -> str:
    """The digest of the whole table."""
    found = nodes.where("level = 0").select("digest").first()
    return found["digest"] if found else ""


@dataclass(frozen=True)
class Difference:
    """Leaves that differ, and how many nodes were compared to find them."""

    leaves: list[str]
    compared: int


def difference(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> Difference:
    """Descends from the roots of two trees of one depth, level by level, below nodes that differ only.

    What comes to the driver are the prefixes of nodes that differ: as many as changed ranges, at most 16 ** depth.
    """
    open_, compared = [""], 0
    for level in range(depth + 1):
        mine = lambda t: t.where(F.col("level") == level).where(F.left("prefix", F.lit(max(level - 1, 0))).isin(open_)).select("prefix", "digest")  # noqa: E731, B023
        both = mine(a).withColumnRenamed("digest", "x").join(mine(b).withColumnRenamed("digest", "y"), "prefix", "full").select("prefix", F.col("x").eqNullSafe(F.col("y")).alias("same")).collect()
        compared += len(both)
        open_ = sorted(r["prefix"] for r in both if not r["same"])
        if not open_:
            return Difference([], compared)
    return Difference(open_, compared)


def changed_rows(a: DataFrame, b: DataFrame, key: str, leaves: list[str], depth: int = DEPTH) -> DataFrame:
    """``key, change`` (added, deleted, changed) of two tables with the same columns and no repeated keys, reading the rows of the given leaves only."""
    mine = lambda t, side: t.where(leaf_of(F.col(key), depth).isin(leaves)).select(key, F.struct(*(c for c in t.columns if c != key)).alias(side))
    both = mine(a, "x").join(mine(b, "y"), key, "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")
