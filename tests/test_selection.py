"""Selections of a face: maps on given edges, refits and circles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.operators.extract import MainPlaneParams
from facetspark.operators.maps import residual_uv_map
from facetspark.operators.planes import Plane
from facetspark.operators.selection import axis_extent, circle_on_selection, edge_bin, map_on_edges, next_index, refit_selection, select, selection_map

FLAT = Plane.of((0, 0, 1), 0.0)
PARAMS = MainPlaneParams(max_threshold_mm=0.5, ransac_iterations=100, min_points_per_cell=1, cell_size_mm=10.0)


def cloud(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "point_id long, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("edges", [[0.0, 1.0], [-3.0, -1.0, 0.5, 0.75, 10.0], list(np.arange(130) ** 1.5)])
def test_bins_between_edges(spark, edges):
    rng = np.random.default_rng(0)
    values = [*rng.uniform(edges[0] - 1, edges[-1] + 1, 300), *edges, edges[-1] + 1e-9]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None), (-2, float("nan"))], "i long, v double")
    got = {r["i"]: r["b"] for r in df.select("i", edge_bin(F.col("v"), edges).alias("b")).collect()}
    for i, v in enumerate(values):
        want = None if not edges[0] <= v <= edges[-1] else min(int(np.searchsorted(edges, v, side="right")) - 1, len(edges) - 2)
        assert got[i] == want, v
    assert got[-1] is None and got[-2] is None
    with pytest.raises(ValueError, match="increasing"):
        edge_bin(F.col("v"), [1.0, 1.0])


def test_map_on_edges_equals_a_histogram(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 4, (2000, 3))
    ue, ve = [-9.0, -3.0, -2.0, 0.0, 5.0], [-4.0, 0.0, 0.25, 8.0]
    want, _, _ = np.histogram2d(x[:, 0], x[:, 1], bins=[ue, ve])
    total, _, _ = np.histogram2d(x[:, 0], x[:, 1], bins=[ue, ve], weights=x[:, 2])
    got = map_on_edges(cloud(spark, x), F.col("x"), F.col("y"), F.col("z"), ue, ve).collect()
    assert {(r["iu"], r["iv"]): r["cnt"] for r in got} == {(i, j): int(want[i, j]) for i, j in zip(*np.nonzero(want), strict=True)}
    assert all(r["mean"] == pytest.approx(total[r["iu"], r["iv"]] / want[r["iu"], r["iv"]]) for r in got)


def test_refit_of_a_selection(spark):
    """A step of the face: the selected part gives a plane of its own, in the axes of the first."""
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 100, (3000, 2)) * [1, 0.5]
    z = rng.normal(0, 0.02, 3000) + np.where(xy[:, 0] > 70, 0.8 + 0.002 * (xy[:, 0] - 70), 0.0)
    df = cloud(spark, np.column_stack([xy, z])).persist()
    base = residual_uv_map(df, FLAT, 20)
    chosen = select(df, base.frame, (22.0, 60.0), (-60.0, 60.0)) if abs(base.frame.u[0]) > 0.9 and base.frame.u[0] > 0 else select(df, base.frame, (-60.0, -22.0), (-60.0, 60.0))
    fit = refit_selection(chosen, FLAT, base.frame, [{"plane_index": 0}, {"plane_index": 4}], 0, PARAMS, 10)
    assert (fit.plane_index, fit.source_plane_index) == (5, 0) and fit.face.status == "ok" and fit.face.reasons == ["selection_refit"] and not fit.bimodal
    assert -fit.face.plane.d == pytest.approx(0.66, abs=0.02) and fit.n_selected == chosen.count() and fit.face.n_points > 0.95 * fit.n_selected
    assert np.dot(fit.map.frame.u, base.frame.u) > 0.999
    on_base = selection_map(chosen, base, FLAT, 20).collect()
    assert sum(r["cnt"] for r in on_base) == fit.n_selected and all(0 <= r["iu"] < 20 and r["mean"] > 0.7 for r in on_base if r["cnt"] > 5)
    with pytest.raises(ValueError, match="too few points"):
        refit_selection(df.limit(49), FLAT, base.frame, [])


def test_circle_of_a_selection(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 2 * np.pi, 400)
    rim = np.column_stack([10 + 6 * np.cos(a), -3 + 6 * np.sin(a), np.zeros(400)]) + rng.normal(0, 0.03, (400, 3))
    stray = rng.uniform(-10, 10, (40, 3)) * [1, 1, 0.01]
    got = circle_on_selection(cloud(spark, np.vstack([rim, stray])), FLAT, [{"circle_index": 2}])
    assert got["circle_index"] == 3 and got["status"] == "ok" and got["diameter_mm"] == pytest.approx(12, abs=0.05) and got["center"][:2] == pytest.approx([10, -3], abs=0.02)
    fixed = circle_on_selection(cloud(spark, rim), FLAT, [], 12.0)
    assert fixed["circle_index"] == 0 and fixed["diameter_mm"] == 12.0 and fixed["diameter_fixed"]
    with pytest.raises(ValueError, match="too few points"):
        circle_on_selection(cloud(spark, rim[:19]), FLAT, [])
    assert next_index([], "k") == 0


def test_extent_along_an_axis(spark):
    df = cloud(spark, [(0, 0, -7), (3, 1, 12), (0, 5, 2)])
    assert axis_extent(df, (0, 0, 2), (0, 0, 1)) == (-9.0, 10.0) and axis_extent(df.filter("point_id = 0"), (0, 0, 0), (0, 0, 1)) == (-50.0, 50.0)


def test_near_and_far_points(spark):
    from facetspark.functions.columns import Vec
    from facetspark.operators.stats import near_far_sample

    rng = np.random.default_rng(0)
    x = rng.uniform(-50, 50, (500, 3))
    df = cloud(spark, x)
    got = [r["point_id"] for r in near_far_sample(df, Vec.of(0, 0, 0), 200).collect()]
    nearest = set(np.argsort((x * x).sum(axis=1))[:100].tolist())
    assert len(got) == len(set(got)) == 200 and nearest <= set(got)
    assert sorted(got) == sorted(r["point_id"] for r in near_far_sample(df.repartition(7), Vec.of(0, 0, 0), 200).collect())
    assert near_far_sample(df.limit(10), Vec.of(0, 0, 0), 200).count() == 10
