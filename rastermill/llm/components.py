"""Connected components by alternating large-star and small-star rounds, each a pair of grouped minima and joins.

Every round is written to the shared folder, so lineage stays short, and the round before it goes.
Minima are combined before they are shuffled, and written before they are joined: so the join of a node
with very many neighbours is one between two tables, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbours and itself."""
    least = materialize(both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    larger = both(edges).where("b > a")
    out = materialize(larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large-stars")
    release(least)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them. edges: a > b."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    out = materialize(moved.where("a != b").distinct(), "small-stars")
    release(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node with an edge; component_id: the least node reachable.

    edges: columns a and b (long), in either order, repeated or looped or not; rows with a null are
    left out. No edges give no rows. The result is a written table: release() it when it has been read.
    """
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(now, "edges"), None
    while True:
        large = large_star(now)
        release(now)
        now = small_star(large)
        release(large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())
    out._scratch = now._scratch
    return out
