"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour (or itself)."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _shared.skew_join(both.where("b > a"), least, "a", "b").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to its smallest neighbour. Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = _shared.skew_join(links, least, "b", "a").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a < b, long) that is not itself the smallest of its component."""
    now, before = _shared.store(links, "links"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        larger = _shared.store(_large_star(now), "links")
        smaller = _shared.store(_small_star(larger), "links")
        _shared.drop(now, larger)
        now, before = smaller, state


def joined(root: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) once components ``root`` (None: none yet) are joined by more ``links``: only their roots are linked anew."""
    if root is None:
        return components(links)
    for c in ("a", "b"):
        links = links.join(root.select(F.col("node").alias(c), F.col("root").alias("of")), c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
    moved = components(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    old = root.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return _shared.store(old.union(moved), "components")
