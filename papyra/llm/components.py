"""Connected components of an edge table, by alternating large and small stars.

Each round moves every node's neighbours to the smallest node known nearby, so that rounds grow with the
logarithm of a component's size, not with its diameter.  Minima are aggregated before they are joined back, no
node's neighbours are ever collected, and each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs, u <> v -> ``(node, root)`` for every node with an edge; root is the least node.

    Repeated and reversed edges don't matter; a table without edges gives no rows; edges with a null are ignored.
    """
    stars = edges.where("u is not null and v is not null and u <> v")
    stars = checkpointed(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(stars)
    while state[0]:
        stars = checkpointed(_small_star(_large_star(stars)))
        now = _state(stars)
        if now == state:
            break
        state = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
