"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.runtime import cut


def _pairs(*ends: tuple[str, str]):
    return F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends]))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = e.select(_pairs(("a", "b"), ("b", "a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(_pairs(("b", "m"), ("a", "m"))).filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Columns node, root: the least node of each node's component, for every node that has an edge to another.

    A node's degree only counts in partial minima, so hubs don't gather in one task beyond their distinct neighbours.
    Null ends and loops make no edge. Each round is cut off from its lineage by a checkpoint.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        now = cut(_small_star(_large_star(now)))
        # the star form is reached when the edge set no longer changes; count and an order-free sum of hashes tell
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
