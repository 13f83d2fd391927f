"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.stages import Stages


def components(stages: Stages, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Contraction: every node takes the label of its neighbour of least hashed priority, edges are relabelled and
    made distinct, until none is left. Hashed priorities make the rounds logarithmic on chains as on stars.
    """
    def rank(c):
        return F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("v"))

    level, maps = 0, []
    e = stages.save(f"{name}-e0", edges.select("a", "b").where("a <> b").distinct())
    while e.limit(1).count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        low = low.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("label"))
        m = stages.save(f"{name}-m{level}", low)
        maps.append(m)
        la, lb = m.select(F.col("node").alias("a"), F.col("label").alias("la")), m.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        nxt = e.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        level += 1
        e = stages.save(f"{name}-e{level}", nxt)
        stages.drop(f"{name}-e{level - 1}")
    if not maps:
        return stages.spark.createDataFrame([], "node long, component long")
    final = maps[-1]
    for m in reversed(maps[:-1]):
        up = final.select(F.col("node").alias("label"), F.col("label").alias("root"))
        final = m.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    final = stages.save(f"{name}-f", final)
    least = final.groupBy("label").agg(F.min("node").alias("component"))
    least = least.select("label", F.least("label", "component").alias("component"))
    out = stages.save(f"{name}-cc", final.join(least, "label").select("node", "component"))
    stages.drop(f"{name}-e{level}", *[f"{name}-m{k}" for k in range(level)], f"{name}-f")
    return out
