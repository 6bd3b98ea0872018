"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, small: bool, tag: str) -> DataFrame:
    """One star step over (u, v) rows with u > v.

    Only the minimum of each neighbourhood is aggregated (combined map-side);
    a hub's rows come back by a join that the adaptive planner can split.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-min")
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(out.filter("u > v").distinct(), f"{tag}-star")


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b of one type): component is the smallest node.

    Null ends and loops are ignored.  Repeated edges count once.  An empty table
    gives an empty result.
    """
    cur = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v")
        .distinct(),
        f"{tag}-edges",
    )

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = mark(cur)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        cur = _star(_star(cur, False, tag), True, tag)
        now = mark(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
