"""Residual maps in a face's own frame, robust fits of a part of the points, and quantiles by narrowing."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetspark.operators import maps, planes, stats

TOP = planes.Plane.of((0, 0, 1), 0.0)


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double").repartition(4)


def turned(xy, degrees, rng, sigma=0.01):
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    return np.column_stack([xy @ np.array([[c, s], [-s, c]]), rng.normal(0, sigma, len(xy))])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=3, max_size=40))
def test_corners_hold_all_points(points):
    p = np.array(points, dtype=np.float64)
    h = maps.corners(p)
    assert {tuple(c) for c in h} <= {tuple(c) for c in p}
    if len(h) >= 3:
        after = np.roll(h, -1, axis=0)
        for a, b in zip(h, after, strict=True):
            assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) <= 1e-9).all()
    t = np.linspace(0, np.pi, 37)
    turns = np.column_stack([np.cos(t), np.sin(t)])
    assert np.allclose([np.ptp(p @ d) for d in turns], [np.ptp(h @ d) for d in turns])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=3, max_size=30, unique=True))
def test_no_direction_gives_a_smaller_rectangle(points):
    p = np.array(points, dtype=np.float64)
    u = maps.rectangle_side(maps.corners(p))
    area = np.ptp(p @ u) * np.ptp(p @ [-u[1], u[0]])
    t = np.linspace(0, np.pi / 2, 500)
    every = [np.ptp(p @ [c, s]) * np.ptp(p @ [-s, c]) for c, s in zip(np.cos(t), np.sin(t), strict=True)]
    assert area <= min(every) + 1e-9
    assert np.ptp(p @ u) >= np.ptp(p @ [-u[1], u[0]]) - 1e-9


@pytest.mark.parametrize("degrees", [45.0, 33.0])
def test_dense_corner_does_not_tilt_the_map(spark, degrees):
    rng = np.random.default_rng(1)
    xy = np.vstack([np.column_stack([rng.uniform(-40, -25, 6000), rng.uniform(-20, 20, 6000)]), rng.uniform((-40, -20), (40, 20), (2000, 2))])
    out = maps.residual_uv_map(cloud(spark, turned(xy, degrees, rng)), TOP, 20)
    span = np.subtract(out.high, out.low)
    assert 78 < span[0] < 82 and 38 < span[1] < 42 and out.n_used == 8000
    assert out.cells.count() > 0.55 * 400
    assert out.cells.agg(F.sum("cnt")).first()[0] == 8000
    # The dense side is nearer to the centroid, so u points away from it.
    assert out.high[0] > -out.low[0]


def test_locked_frame_keeps_the_source_axes(spark):
    rng = np.random.default_rng(2)
    xyz = np.column_stack([rng.uniform(-40, 40, 12000), rng.uniform(-10, 10, 12000), rng.normal(0, 0.01, 12000)])
    full = maps.residual_uv_map(cloud(spark, xyz), TOP)
    side = full.frame.u[0]  # the strip at the far negative end of u
    strip = cloud(spark, xyz[xyz[:, 0] * np.sign(side) < -25])
    own = maps.residual_uv_map(strip, TOP)
    assert abs(np.dot(own.frame.u, full.frame.u)) < 0.5
    held = maps.residual_uv_map(strip, TOP, frame=full.frame)
    assert np.dot(held.frame.u, full.frame.u) > 0.99 and np.dot(held.frame.v, full.frame.v) > 0.99
    assert held.high[0] < 0


def test_small_and_broken_faces(spark):
    empty = cloud(spark, np.empty((0, 3)))
    assert maps.residual_uv_map(empty, TOP) is None
    two = maps.residual_uv_map(cloud(spark, [(0, 0, 1), (2, 0, 3)]), TOP, 4)
    assert two.n_used == 2 and two.low[2] == -1
    line = maps.residual_uv_map(cloud(spark, [(k, k, 0) for k in range(9)]), TOP, 4)
    assert np.isclose(abs(np.dot(line.frame.u, (2**-0.5, 2**-0.5, 0))), 1)
    same = maps.residual_uv_map(cloud(spark, [(1, 1, 1)] * 5), TOP, 4)
    assert same.cells.count() == 1
    odd = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 1.0, 1.0), (3, float("nan"), 1.0, 1.0), (4, float("inf"), 1.0, 1.0)], "point_id long, x double, y double, z double")
    assert maps.residual_uv_map(odd, TOP, 4).n_used == 1


def test_histogram_summary(spark):
    row = stats.histogram_summary(cloud(spark, [(0, 0, k / 10) for k in range(11)]), F.col("z"), 0.5).first()
    assert (row["n_used"], row["n_outside"], row["threshold"]) == (11, 5, 0.5)


def test_fit_of_a_part(spark):
    """Two sheets: only the points named by the mask are fitted or count as inliers."""
    rng = np.random.default_rng(4)
    xy = rng.uniform(-50, 50, (4000, 2))
    z = rng.normal(0, 0.03, 4000) + np.where(np.arange(4000) % 2 == 0, 0.0, 0.05)
    points = cloud(spark, np.column_stack([xy, z]))
    fit = planes.robust_fit_plane(points, 0.1, among=F.col("point_id") % 2 == 0)
    assert abs(fit.plane.d) < 5e-3 and fit.n_inliers <= 2000
    assert points.filter(fit.inlier()).filter("point_id % 2 = 1").count() == 0
    assert points.filter(fit.inlier()).count() == fit.n_inliers


@pytest.mark.parametrize("name", ["normal", "outliers", "ties", "halves", "one", "bins"])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantile_is_exact(spark, name, q):
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(0, 1, 1001), "outliers": np.concatenate([rng.normal(0, 1e-3, 600), [1e9, -1e12, 1e15]]), "ties": np.repeat([1.0, 2.0, 2.0, 5.0], 50),
        "halves": np.concatenate([np.zeros(50), np.ones(50)]), "one": np.array([3.5]), "bins": np.arange(100.0),
    }[name]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "r double")
    got = stats.quantile(frame, F.col("r"), q, bins=8, few=5)
    assert got == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-15)


def test_quantile_of_nothing(spark):
    assert stats.quantile(spark.createDataFrame([(None,)], "r double"), F.col("r")) is None
    assert planes.mad_sigma(cloud(spark, np.empty((0, 3))), F.col("x")) is None
