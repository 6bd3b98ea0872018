"""Residual statistics, histograms, maps, voxel grids and circle sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Vec, bin_index, voxel
from .quantiles import group_quantiles, join_groups


def residual_stats(frame: DataFrame, residual: Column, keys: list[str]) -> DataFrame:
    """n, mean, mad_sigma, max_abs, std, rms, p95_abs by group; nulls where a group has no residual.

    The medians are exact and no task holds a group: see ``group_quantiles``.
    """
    r = frame.select(*keys, residual.alias("r"))
    med = group_quantiles(r, keys, {"med": (F.col("r"), 0.5)})
    both = join_groups(r, med, keys) if keys else r.crossJoin(F.broadcast(med))  # one row if there are no keys
    a = F.abs("r")
    order = group_quantiles(both, keys, {"mad_sigma": (F.abs(F.col("r") - F.col("med")) * 1.4826, 0.5), "p95_abs": (a, 0.95)})
    sums = r.groupBy(*keys).agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.max(a).alias("max_abs"), F.stddev_pop("r").alias("std"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"),
    )
    out = join_groups(sums, order, keys, "left") if keys else sums.join(F.broadcast(order), F.lit(True), "left")  # one row
    return out.select(*keys, "n", "mean", "mad_sigma", "max_abs", "std", "rms", "p95_abs")


def quantile(frame: DataFrame, value: Column, q: float = 0.5, bins: int = 4096, few: int = 100_000) -> float | None:
    """The exact q-quantile of all finite values, interpolated between neighbours; None for none.

    Each round counts the values by bins of the range left, one row a bin and task, and
    goes on in the bin that holds the wanted rank, from its smallest to its largest
    value.  The last ``few`` values are sorted on the driver; equal ones end it at once.
    """
    r = frame.select(value.cast("double").alias("r")).filter(F.abs("r") < float("inf"))
    row = r.agg(F.count("r").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).first()
    n, low, high, before = row["n"], row["low"], row["high"], 0
    if not n:
        return None
    at = q * (n - 1)
    first, share = int(at), at - int(at)
    second = first + (share > 0)
    while low < high and n > few:
        width = high / 2 - low / 2
        if width == 0:  # neighbours among the smallest doubles there are
            break
        part = r.filter(F.col("r").between(low, high))
        spot = F.least(F.floor((F.col("r") / 2 - low / 2) / width * bins).cast("int"), F.lit(bins - 1))
        counts = part.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("bin").collect()  # a row a bin
        for k, cell in enumerate(counts):
            if first < before + cell["n"]:
                break
            before += cell["n"]
        low, high, n = cell["low"], cell["high"], cell["n"]
        if second >= before + n:  # the two ranks are the ends of neighbouring bins
            return (1 - share) * high + share * counts[k + 1]["low"]
    if low == high or n > few:
        return low
    left = sorted(x[0] for x in r.filter(F.col("r").between(low, high)).collect())  # at most ``few``
    return (1 - share) * left[first - before] + share * left[second - before]


def residual_histogram(frame: DataFrame, residual: Column, threshold: float, bins: int = 81) -> DataFrame:
    """(bin, cnt) over +-max(threshold, 1e-4); residuals beyond are in no bin."""
    t = max(threshold, 1e-4)
    return frame.select(bin_index(residual, -t, t, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("cnt"))


def histogram_summary(frame: DataFrame, residual: Column, threshold: float) -> DataFrame:
    """One row (n_used, n_outside, threshold) that goes with ``residual_histogram``: all residuals, and those beyond its range."""
    t = max(threshold, 1e-4)
    return frame.agg(F.count(residual).alias("n_used"), F.count_if(F.abs(residual) > t).alias("n_outside"), F.lit(t).alias("threshold"))


def bimodality(frame: DataFrame, residual: Column, sigma: float, bins: int = 81) -> DataFrame:
    """One row (n, peak, bimodal): is there a second local maximum beyond 2 sigma and over 30 % of the peak?

    The histogram has at most ``bins`` rows, so its windows need no partition.
    """
    width = 12 * sigma / bins
    hist = frame.select(bin_index(residual, -6 * sigma, 6 * sigma, bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("cnt"))
    every = frame.sparkSession.range(bins).select(F.col("id").alias("bin"))
    full = every.join(hist, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    order = Window.orderBy("bin")
    full = full.select("bin", "cnt", F.max("cnt").over(order.rowsBetween(-2, 2)).alias("top"))
    peak = full.agg(F.max_by(F.struct("bin", "cnt"), F.struct("cnt", -F.col("bin"))).alias("p")).select("p.*").withColumnsRenamed({"bin": "peak", "cnt": "most"})
    second = (F.abs(F.col("bin") - F.col("peak")) * width > 2 * sigma) & (F.col("cnt") > 0.3 * F.col("most")) & (F.col("cnt") == F.col("top"))
    n = frame.agg(F.count(residual).alias("n"))
    out = full.crossJoin(F.broadcast(peak)).agg(F.first("peak").alias("peak"), F.max(second.cast("int")).alias("two"), F.first("most").alias("most"))
    return out.crossJoin(n).select("n", "peak", ((F.col("n") >= 1000) & (F.col("most") > 0) & (F.col("two") == 1)).alias("bimodal"))


def mean_map(frame: DataFrame, u: Column, v: Column, value: Column, extents: tuple[float, float, float, float], bins: int) -> DataFrame:
    """(iu, iv, cnt, mean) over a grid of the extents (u0, u1, v0, v1); a cell without points is absent."""
    u0, u1, v0, v1 = extents
    cells = frame.select(bin_index(u, u0, u1, bins).alias("iu"), bin_index(v, v0, v1, bins).alias("iv"), value.alias("r"))
    return cells.dropna(subset=["iu", "iv"]).groupBy("iu", "iv").agg(F.count("*").alias("cnt"), F.avg("r").alias("mean"))


def extents(frame: DataFrame, *values: Column) -> list[tuple[float, float]]:
    row = frame.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("a", F.min), ("b", F.max))]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(values))]


def voxel_downsample(cloud: DataFrame, cell: float) -> DataFrame:
    """(point_id, cnt): of each occupied voxel the smallest id and the number of points.

    A cell of 0 or less keeps every point.  One shuffle of a row a voxel and task.
    """
    if cell <= 0:
        return cloud.select("point_id", F.lit(1).cast("long").alias("cnt"))
    (x0, _), (y0, _), (z0, _) = extents(cloud, F.col("x"), F.col("y"), F.col("z"))
    keys = voxel(Vec.cols("x", "y", "z"), Vec.of(x0, y0, z0), cell)
    return cloud.groupBy(*[k.alias(n) for k, n in zip(keys, "ijk", strict=True)]).agg(F.min("point_id").alias("point_id"), F.count("*").alias("cnt")).select("point_id", "cnt")


def occupancy(frame: DataFrame, u: Column, v: Column, low: tuple[float, float], cell: float, least: int) -> DataFrame:
    """(iu, iv, cnt) of the grid cells that hold at least ``least`` points."""
    iu, iv = (F.floor((c - F.lit(b)) / F.lit(cell)).cast("long") for c, b in ((u, low[0]), (v, low[1])))
    return frame.groupBy(iu.alias("iu"), iv.alias("iv")).agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= least)


def display_sample(cloud: DataFrame, cell: float, most: int, seed: int = 0) -> DataFrame:
    """Voxel representatives, at most ``most`` of them in hash order (a display cap is the feature here)."""
    return voxel_downsample(cloud, cell).orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(most)


def near_far_sample(cloud: DataFrame, center: Vec, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` points (a cap is the feature): half of them the nearest to ``center``, the rest by hash.

    Both come from a hash-ordered pool of four times as many, so that a plane of them rests
    on the neighbourhood and still sees how far the region goes.
    """
    share = F.xxhash64("point_id", F.lit(seed))
    pool = cloud.withColumn("share__", share).orderBy("share__", "point_id").limit(4 * most)
    far = (Vec.cols("x", "y", "z") - center).norm2()
    near = pool.orderBy(far, "point_id").limit(most // 2)
    rest = pool.join(near.select("point_id"), "point_id", "left_anti").orderBy("share__", "point_id").limit(most - most // 2)
    return near.unionByName(rest.select(near.columns)).drop("share__")


def circle_sums(frame: DataFrame, u: Column, v: Column, keys: list[str]) -> DataFrame:
    """Least-squares circle of each group: (n, cu, cv, radius), from mergeable covariances."""
    w = u * u + v * v
    s = frame.select(*keys, u.alias("u"), v.alias("v"), w.alias("w")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.avg("w").alias("mw"), F.covar_pop("u", "u").alias("uu"), F.covar_pop("v", "v").alias("vv"),
        F.covar_pop("u", "v").alias("uv"), F.covar_pop("u", "w").alias("uw"), F.covar_pop("v", "w").alias("vw"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    cu = (F.col("uw") * F.col("vv") - F.col("vw") * F.col("uv")) / (2 * det)
    cv = (F.col("vw") * F.col("uu") - F.col("uw") * F.col("uv")) / (2 * det)
    s = s.withColumns({"cu": F.when(det != 0, cu), "cv": F.when(det != 0, cv)})
    r2 = F.col("mw") - 2 * (F.col("cu") * F.col("mu") + F.col("cv") * F.col("mv")) + F.col("cu") * F.col("cu") + F.col("cv") * F.col("cv")
    return s.select(*keys, "n", "cu", "cv", F.sqrt(F.greatest(r2, F.lit(0.0))).alias("radius"))
