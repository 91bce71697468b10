"""Connected components by alternating stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours (the larger ones, or itself and the smaller ones) to the least of them all."""
    if large:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
    near = both.withColumn("m", least)
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select("v", "m").union(near.select("u", "m")).toDF("u", "v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the edges (u, v): root is the least node of its component.

    Large and small stars alternate until nothing moves. Edges with a null end and loops are
    passed over, repeated edges count once, no edges give no rows. Each round is written to the
    shared folder, so that a lost executor costs one round at most.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(now)
    for _ in range(rounds):
        if not was[0]:
            break
        now = materialize(_stars(_stars(now, True), False), "stars")
        new = mark(now)
        if new == was:
            break
        was = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select("v", "v").distinct())
