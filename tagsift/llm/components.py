"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step replaces the edges by others that keep the components and lean towards each component's
smallest vertex; it ends when every vertex points at that vertex.  Edges stay a table: nothing but two
numbers a step reaches the driver.  A vertex with very many neighbours is only ever aggregated (with
partial minima before the shuffle) and joined (where AQE splits it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsift.llm.shared import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    out = down.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(near.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components", most_steps: int = 60) -> DataFrame:
    """(v, component) of every vertex that isn't the smallest of its component; ``edges`` has (u, v), u <> v."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = _digest(now)
    for _ in range(most_steps if before[0] else 0):
        now = written(_small_star(_large_star(now)), name)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("v"), F.col("v").alias("component"))
