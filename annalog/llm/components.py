"""Connected components of a link table by alternating large and small stars.

Each round replaces links by links to the smallest neighbour: first every larger
neighbour of a node, then the node and its smaller neighbours. A node with very many
neighbours is a plain aggregate and a join, never one task's list. About log2(size)
rounds; each is stored in the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def _digest(links: DataFrame) -> tuple:
    # `xxhash64 % 2^31` keeps the sum far from overflow.
    total = F.sum(F.xxhash64("a", "b") % (1 << 31))
    return tuple(links.agg(F.count("*"), total).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b; any ordered type): root is
    the smallest node that can be reached. Links to itself, nulls and repeated links
    count for nothing; no links, no rows."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now)
    digest = _digest(now)
    while digest[0]:
        after = cut_lineage(_small_star(_large_star(now)))
        new = _digest(after)
        if new == digest:
            break
        now, digest = after, new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
