"""Depth layers along a ray: sort by depth, cut where the gap is large (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Vec
from ..scratch import materialize
from .numbering import numbered
from .quantiles import group_quantiles, join_groups


def ray_depths(cloud: DataFrame, origin: Vec, direction: Vec, radius: float) -> DataFrame:
    """(point_id, t) of the points ahead of the origin within ``radius`` of the ray; direction has length 1."""
    rel = Vec.cols("x", "y", "z") - origin
    t = rel.dot(direction)
    off = rel - direction.scaled(t)
    return cloud.select("point_id", t.alias("t"), off.norm().alias("radial")).filter((F.col("t") > 0) & (F.col("radial") <= radius)).select("point_id", "t")


def depth_layers(depths: DataFrame, keys: list[str], gap: float | None = None, least: int = 1, min_gap: float = 8.0) -> DataFrame:
    """(layer, seed_id, depth, n_points) of each group, front to back from layer 0.

    A new layer begins where the step from the point before is larger than ``gap``; if
    that is None, than max(min_gap, 10 * median step) of the group.  Layers of fewer
    than ``least`` points are dropped and the rest numbered anew.  The seed is the
    front point (the smallest id of equal depths), the depth the mean.

    Points are dealt into ranges of depth and cut there; a row a range and group carries
    the last depth and the number of cuts before it, which joins the layers of
    neighbouring ranges.  So a group, or a single ray, may be of any size.
    """
    one = [] if keys else ["all__"]
    by = [*keys, *one]
    d = depths.select(*keys, *[F.lit(0).alias(c) for c in one], "point_id", "t")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(d.repartitionByRange(parts, *by, "t", "point_id").withColumn("range__", F.spark_partition_id()), "layers-dealt")
    spot = [*by, "range__"]
    across = Window.partitionBy(*by).orderBy("range__")  # a row a range
    edges = dealt.groupBy(*spot).agg(F.max("t").alias("last")).withColumn("before", F.lag("last").over(across)).drop("last")
    inside = Window.partitionBy(*spot).orderBy("t", "point_id")
    rows = join_groups(dealt.withColumn("prior", F.lag("t").over(inside)), edges, spot)
    rows = materialize(rows.withColumn("step", F.col("t") - F.coalesce("prior", "before")).drop("prior", "before"), "layers-steps")
    if gap is None:
        steps = group_quantiles(rows.filter("step is not null"), by, {"mid": (F.col("step"), 0.5)})
        rows = join_groups(rows, steps, by, "left").withColumn("gap", F.greatest(F.lit(float(min_gap)), 10 * F.coalesce("mid", F.lit(0.0)))).drop("mid")
    else:
        rows = rows.withColumn("gap", F.lit(float(gap)))
    cut: Column = F.coalesce((F.col("step") > F.col("gap")).cast("int"), F.lit(0))
    rows = rows.withColumn("cut", cut)
    cuts = rows.groupBy(*spot).agg(F.sum("cut").alias("cuts"))
    cuts = cuts.withColumn("ahead", F.sum("cuts").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cuts")).drop("cuts")
    rows = rows.withColumn("run", F.sum("cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = join_groups(rows, cuts, spot).withColumn("run", F.col("run") + F.col("ahead"))
    layers = rows.groupBy(*by, "run").agg(
        F.min(F.struct("t", "point_id"))["point_id"].alias("seed_id"), F.avg("t").alias("depth"), F.count("*").alias("n_points"),
    ).filter(F.col("n_points") >= least)
    return numbered(layers, ["run"], "layer", by).select(*keys, F.col("layer").cast("int").alias("layer"), "seed_id", "depth", "n_points")


def front_layers(cloud: DataFrame, origin: Vec, direction: Vec, radius: float, enough: int = 15, least: int = 6) -> DataFrame:
    """Layers with the radius widened by 1, 2, 4, 8 until the front layer has ``enough`` points; else the longest list."""
    best, most = None, -1
    for k in (1, 2, 4, 8):
        layers = materialize(depth_layers(ray_depths(cloud, origin, direction, radius * k), [], None, least), "layers-front")
        front = layers.filter("layer = 0").first()
        if front and front["n_points"] >= enough:
            return layers
        n = layers.count()
        if n > most:
            best, most = layers, n
    return best
