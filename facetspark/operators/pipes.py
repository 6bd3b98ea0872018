"""Algebraic cylinders of many groups: main axis, circle across it, and half a step to the median radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Vec, axis_distance
from .quantiles import group_quantiles, join_groups
from .rounds import basis, three_point_circles

_P = ("x", "y", "z")
_TWO = [(a, b) for i, a in enumerate(_P) for b in _P[i:]]
_THREE = [(a, b, c) for i, a in enumerate(_P) for j, b in enumerate(_P[i:], i) for c in _P[j:]]
_CYLINDER = "px double, py double, pz double, ux double, uy double, uz double, diameter_mm double"


def central_moments(cloud: DataFrame, key: str) -> DataFrame:
    """(key, n, m*, s**, t***): of each group the mean and the mean products of two and three centred coordinates.

    Two scans, each with one row a group and task: the centre first, so that products of
    coordinates far from the origin do not cancel.
    """
    mean = cloud.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in _P])
    rows = join_groups(cloud.select(key, *_P), mean.select(key, *[f"m{a}" for a in _P]), [key])
    c = {a: F.col(a) - F.col(f"m{a}") for a in _P}

    def mean_of(names: tuple[str, ...]) -> Column:
        out = c[names[0]]
        for a in names[1:]:
            out = out * c[a]
        return F.avg(out).alias("st"[len(names) - 2] + "".join(names))

    sums = rows.groupBy(key).agg(*[mean_of(names) for names in (*_TWO, *_THREE)])
    return join_groups(mean, sums, [key])


def _tensors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, t = np.zeros((3, 3)), np.zeros((3, 3, 3))
    place = {a: i for i, a in enumerate(_P)}
    for i, a in enumerate(_P):
        for j, b in enumerate(_P):
            s[i, j] = row["s" + "".join(sorted((a, b), key=place.get))]
            for k, c in enumerate(_P):
                t[i, j, k] = row["t" + "".join(sorted((a, b, c), key=place.get))]
    return np.array([row[f"m{a}"] for a in _P]), s, t


def cross_circle(s: np.ndarray, t: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, float | None]:
    """Centre (from the mean) and radius of the least-squares circle across ``u``, from centred moments turned into its plane."""
    e = np.stack(basis(u))
    flat = e @ s @ e.T
    # x (x^2 + y^2) and y (x^2 + y^2) of the plane's coordinates.
    third = np.einsum("ijk,pi,qj,qk->p", t, e, e, e)
    c, *_ = np.linalg.lstsq(2 * flat, third, rcond=None)
    r2 = float(np.trace(flat) + c @ c)
    return c @ e, float(np.sqrt(r2)) if np.isfinite(r2) and r2 > 0 else None


def refine_cylinders(cloud: DataFrame, key: str, init: DataFrame | None = None, diameter_mm: float | None = None, update_direction: bool = True, iterations: int = 10) -> DataFrame:
    """(key, n, px, py, pz, ux, uy, uz, diameter_mm) of each group with three points or more.

    An iteration takes the main axis of the points (with the sign of the last one), a
    least-squares circle across it, and for the diameter the mean of the circle's and twice
    the median distance from the axis.  All of it comes from the moments of the points,
    which do not change, so that the iterations cost the scans of ``central_moments`` and
    one exact median of all groups together.  ``init`` (key, ux, uy, uz, diameter_mm) gives
    signs and, with ``update_direction`` off, the axes; without it the largest component
    of an axis is positive.  A given ``diameter_mm`` is kept.
    """
    kind = dict(cloud.dtypes)[key]
    cloud = cloud.filter(F.col(key).isNotNull()).select(key, *_P)
    moments = central_moments(cloud, key).filter("n >= 3")
    names = [f"i{c}" for c in ("ux", "uy", "uz", "d")]
    if init is None:
        moments = moments.select("*", *[F.lit(None).cast("double").alias(c) for c in names])
    else:
        moments = join_groups(moments, init.select(key, *[F.col(a).alias(b) for a, b in zip(("ux", "uy", "uz", "diameter_mm"), names, strict=True)]), [key], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                mean, s, t = _tensors(row)
                given = np.array([row[c] for c in names[:3]], dtype=np.float64)
                has = bool(np.isfinite(given).all())
                u = given / np.linalg.norm(given) if has else None
                if update_direction or u is None:
                    v = np.linalg.eigh(s)[1][:, 2]
                    u = v if (v @ u > 0 if has else v[np.abs(v).argmax()] > 0) else -v
                c, radius = cross_circle(s, t, u)
                out.append([row[key], row["n"], *(mean + c), *u, np.nan if radius is None else 2 * radius, row["id"]])
            yield pd.DataFrame(out, columns=[key, "n", "px", "py", "pz", "ux", "uy", "uz", "diameter_mm", "first"])

    fits = moments.mapInPandas(run, f"{key} {kind}, n long, {_CYLINDER}, first double")
    fits = fits.withColumn("diameter_mm", F.when(~F.isnan("diameter_mm"), F.col("diameter_mm")))
    if diameter_mm is not None:
        return fits.withColumn("diameter_mm", F.lit(float(diameter_mm))).drop("first")
    rho = axis_distance(Vec.cols(*_P), Vec.cols("px", "py", "pz"), Vec.cols("ux", "uy", "uz"))
    mid = group_quantiles(join_groups(cloud, fits.drop("n"), [key]), [key], {"mid": (rho, 0.5)})
    out = join_groups(fits, mid, [key], "left")
    # Where no circle fits, the first diameter moves half way to twice the median in each iteration.
    far = 2 * F.col("mid") + (F.coalesce("first", 2 * F.col("mid")) - 2 * F.col("mid")) / (2.0**iterations)
    return out.withColumn("diameter_mm", F.when(F.col("mid") > 0, F.coalesce(0.5 * (F.col("diameter_mm") + 2 * F.col("mid")), far)).otherwise(F.coalesce("diameter_mm", "first"))).drop("first", "mid")


def cylinder_of_three(a, b, c, diameter_mm: float | None = None) -> dict | None:
    """The cylinder through three points whose axis is the normal of their circle; None where they have none."""
    ok, center, normal, radius = three_point_circles(*(np.asarray(p, dtype=np.float64)[None] for p in (a, b, c)))
    if not ok[0] or radius[0] <= 0:
        return None
    return {"point": tuple(center[0]), "direction": tuple(normal[0]), "diameter_mm": diameter_mm if diameter_mm and diameter_mm > 0 else 2 * float(radius[0])}
