"""Hand values, analytic scenes and the PLY format."""

import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from facetspark.operators import planes, regions, rounds
from facetspark.operators.extract import MainPlaneParams, extract_main_plane
from facetspark.plans.recipe import Recipe, reduce_survey
from facetspark.plans.schema import migrate_recipe
from facetspark.sources.ply import read_header, read_ply, write_ply

FACES = {"left": ("plane", [1, 0, 0, 50]), "front": ("plane", [0, 1, 0, 20]), "top": ("plane", [0, 0, 1, -100])}
DOC = {
    "faces": {k: {"name": k} for k in FACES},
    "construct": [
        {"id": "l2", "op": "offset", "plane": "left", "distance_mm": 50},
        {"id": "f2", "op": "offset", "plane": "front", "distance_mm": 20},
        {"id": "ax", "op": "intersect_planes", "plane_a": "l2", "plane_b": "f2"},
        {"id": "t", "op": "intersect_line_plane", "line": "ax", "plane": "top"},
    ],
}


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")


def test_beam_target(spark):
    out = reduce_survey(spark, DOC, FACES)
    assert out["points"]["t"]["xyz"] == pytest.approx([0, 0, 100])
    assert out["points"]["t"]["parents"] == ["ax", "top"]


@pytest.mark.parametrize("change", [
    lambda d: d["construct"].append({"id": "l2", "op": "offset", "plane": "left", "distance_mm": 1}),
    lambda d: d["construct"].append({"id": "q", "op": "intersect_planes", "plane_a": "left", "plane_b": "left"}),
    lambda d: d["construct"].insert(0, {"id": "q", "op": "intersect_line_plane", "line": "ax", "plane": "top"}),
    lambda d: d["construct"].append({"id": "aligned.x", "op": "offset", "plane": "left", "distance_mm": 1}),
    lambda d: d.update(units="inch"),
    lambda d: d.update(version=3),
    lambda d: d.update(faces={}),
    lambda d: d.update(frame={"axis": "ax"}),
    lambda d: d.update(export=["nothing"]),
])
def test_bad_recipes(change):
    import copy

    doc = copy.deepcopy(DOC)
    change(doc)
    with pytest.raises((ValueError, KeyError)):
        Recipe.of(doc)


def test_edit_recipe():
    r = Recipe.of(DOC)
    assert r.dependents("l2") == ["ax", "t"]
    assert [s["id"] for s in r.without("l2").steps] == ["f2"]
    assert r.renamed("ax", "axis").steps[-1]["line"] == "axis"
    assert migrate_recipe({"version": 1, "construct": [{"id": "o", "op": "offset", "of": "p"}]})["construct"][0]["plane"] == "p"


def test_parallel_planes_are_an_error(spark):
    doc = {"faces": {k: {"name": k} for k in ("a", "b")}, "construct": [{"id": "x", "op": "intersect_planes", "plane_a": "a", "plane_b": "b"}]}
    with pytest.raises(ValueError):
        reduce_survey(spark, doc, {"a": ("plane", [1, 0, 0, 0]), "b": ("plane", [1, 0, 0, 5])})


def scene(n=4000, seed=1, noise=0.03):
    rng = np.random.default_rng(seed)
    n0 = np.array([0.3, -0.5, 0.8])
    n0 /= np.linalg.norm(n0)
    u, v = rounds.basis(n0)
    uv = rng.uniform(-50, 50, (n, 2))
    return n0, 250.0, uv[:, :1] * u + uv[:, 1:] * v - 250.0 * n0 + rng.normal(0, noise, (n, 1)) * n0


def test_robust_plane(spark):
    n0, d, xyz = scene()
    far = xyz[:600] + n0 * 0.5
    fit = planes.robust_fit_plane(cloud(spark, np.concatenate([xyz, far])), threshold=0.1)
    assert np.arccos(min(1.0, abs(np.dot(fit.plane.normal, n0)))) < 1e-3
    assert abs(abs(fit.plane.d) - d) < 2e-2


def test_main_plane_keeps_the_clicked_face(spark):
    n0, _, xyz = scene(3000)
    u, _ = rounds.basis(n0)
    both = np.concatenate([xyz, xyz[:1500] + 300 * u])
    out = extract_main_plane(cloud(spark, both), MainPlaneParams(min_points=500, min_points_per_cell=2, cell_size_mm=8.0, ransac_iterations=200))
    assert out.status == "ok" and out.n_components >= 2
    assert out.members.filter("point_id >= 3000").count() == 0 and out.n_points > 2700


def test_cylinder_and_circle(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 2 * np.pi, 800)
    xyz = np.stack([40 * np.cos(a), 40 * np.sin(a), rng.uniform(-100, 100, 800)], axis=1) + rng.normal(0, 0.05, (800, 3))
    got = rounds.fit_cylinders(cloud(spark, xyz).withColumn("grp", F.lit(1)), "grp", rounds.RoundParams(threshold_mm=2.0)).first()
    assert got["status"] == "ok" and abs(got["diameter_mm"] - 80) < 1 and abs(got["uz"]) > 0.999
    ring = np.stack([25 * np.cos(a), 25 * np.sin(a), 0 * a], axis=1) + rng.normal(0, 0.05, (800, 3))
    df = cloud(spark, ring).selectExpr("*", "1 AS grp", "0D AS nx", "0D AS ny", "1D AS nz", "0D AS d")
    got = rounds.fit_circles(df, "grp").first()
    assert abs(got["diameter_mm"] - 50) < 1.5 and abs(got["pz"]) < 1e-9


@pytest.mark.parametrize("thr, diameter, axis", [(None, None, None), (2.0, 80.0, (0.0, 0.0, 1.0))])
def test_large_groups_are_fitted_on_all_points(spark, thr, diameter, axis):
    rng = np.random.default_rng(8)
    a = rng.uniform(0, 2 * np.pi, 2400)
    xyz = np.stack([40 * np.cos(a) + 900, 40 * np.sin(a), rng.uniform(-100, 100, 2400)], axis=1) + rng.normal(0, 0.05, (2400, 3))
    xyz[:200] += rng.normal(0, 10, (200, 3))
    df = cloud(spark, xyz).selectExpr("*", "point_id % 3 AS grp", "0D AS nx", "0D AS ny", "1D AS nz", "0D AS d")
    flat = df.withColumn("z", F.lit(0.0))
    fits = []
    for cap in (80_000, 500):
        p = rounds.RoundParams(threshold_mm=thr, diameter_mm=diameter, max_points=cap)
        fits.append([rounds.fit_cylinders(df, "grp", p, axis).orderBy("grp").collect(), rounds.fit_circles(flat, "grp", p).orderBy("grp").collect()])
    for whole, stepped in zip(*fits, strict=True):
        assert [(r["grp"], r["status"]) for r in stepped] == [(g, "ok") for g in range(3)]
        for w, g in zip(whole, stepped, strict=True):
            assert g["n_inliers"] > 700 and abs(g["n_inliers"] - w["n_inliers"]) <= 8  # the start differs
            assert abs(g["diameter_mm"] - w["diameter_mm"]) < 0.02 and g["mad_sigma_mm"] == pytest.approx(w["mad_sigma_mm"], rel=0.05)


def test_components_are_four_connected(spark):
    cells = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (1, 2, 5), (5, 5, 9)], "iu long, iv long, cnt long")
    labels = {(r["iu"], r["iv"]): r["label"] for r in regions.grid_components(cells).collect()}
    assert labels == {(0, 0): 1, (0, 1): 1, (1, 2): 2, (5, 5): 3}


def test_radius_join_is_brute_force(spark):
    rng = np.random.default_rng(3)
    xyz = rng.uniform(-50, 50, (400, 3))
    c = cloud(spark, xyz)
    got = {tuple(r) for r in regions.radius_join(c, c.filter("point_id < 20").withColumnRenamed("point_id", "center_id"), 25.0).collect()}
    assert got == {(i, j) for i in range(20) for j in range(400) if ((xyz[i] - xyz[j]) ** 2).sum() <= 625}


def test_radius_join_is_written_as_runs_of_a_center(spark, tmp_path):
    xyz = np.vstack([np.random.default_rng(9).uniform(-20, 20, (12_000, 3)), np.zeros((1_000, 3))])
    c = cloud(spark, xyz)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        regions.radius_join(c, c.filter("point_id % 100 = 0").withColumnRenamed("point_id", "center_id"), 20.0).write.parquet(f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs, got = 0, []
    for f in tmp_path.glob("out/*.parquet"):
        t = pq.ParquetFile(f).read()
        q, p = t["center_id"].to_numpy(), t["point_id"].to_numpy()
        runs += 1 + np.count_nonzero(q[1:] != q[:-1])
        got += zip(q.tolist(), p.tolist(), strict=True)
    i, j = np.nonzero(((xyz[::100, None] - xyz[None]) ** 2).sum(axis=2) <= 400)
    assert sorted(got) == sorted(zip((100 * i).tolist(), j.tolist(), strict=True))
    assert runs <= len(got) / 20


def test_radius_join_of_few_bytes_keeps_all_tasks(spark):
    c = cloud(spark, np.random.default_rng(10).uniform(-50, 50, (2_000, 3)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        got = regions.radius_join(c, c.filter("point_id % 10 = 0").withColumnRenamed("point_id", "center_id"), 20.0)
        assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("binary", [True, False])
def test_ply_round_trip(spark, tmp_path, binary):
    xyz = np.random.default_rng(4).normal(size=(57, 3))
    path = str(tmp_path / "a.ply")
    write_ply(cloud(spark, xyz), path, binary)
    got = read_ply(spark, path, 20).orderBy("point_id").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], xyz, atol=0 if binary else 1e-9)


def test_ply_errors(tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    p = tmp_path / "b.ply"
    p.write_bytes(head + struct.pack("<3f", 1, 2, 3))
    with pytest.raises(ValueError, match="truncated"):
        read_header(str(p))
    for bad in (b"plx\n", head.replace(b"little", b"big"), head.replace(b"property float x\n", b""), head.replace(b"property float x", b"property list uchar int x")):
        p.write_bytes(bad)
        with pytest.raises((ValueError, KeyError)):
            read_header(str(p))


def patch(rng, n, size, height=0.0, sigma=0.03):
    return np.column_stack([rng.uniform(-size, size, n), rng.uniform(-size, size, n), height + rng.normal(0, sigma, n)])


def test_robust_plane_beside_outliers_and_a_ghost(spark):
    rng = np.random.default_rng(11)
    slab = np.column_stack([rng.uniform(-50, 50, (4000, 2)), rng.uniform(-1, 1, 4000)])
    fit = planes.robust_fit_plane(cloud(spark, np.concatenate([patch(rng, 20_000, 50), slab])), 0.1)
    assert fit.converged and np.arccos(fit.plane.normal[2]) < 1e-4 and abs(fit.plane.d) < 3e-3
    both = cloud(spark, np.concatenate([patch(rng, 20_000, 50), patch(rng, 3000, 50, 0.5)]))
    fit = planes.robust_fit_plane(both)
    assert abs(fit.plane.d) < 5e-3 and fit.threshold == pytest.approx(0.09, rel=0.25)
    some = planes.robust_fit_plane(both, 0.1, among=F.col("z") > 0.3)
    assert abs(some.plane.d + 0.5) < 0.01 and some.n_inliers >= 2900


def test_parallel_sheets_are_two_planes(spark):
    from facetspark.operators.extract import MultiPlaneParams, extract_planes

    rng = np.random.default_rng(12)
    found = extract_planes(cloud(spark, np.concatenate([patch(rng, 8000, 20), patch(rng, 6000, 20, 0.5)])), MultiPlaneParams(min_plane_points=2000))
    assert [round(-f["result"].plane.d, 1) + 0.0 for f in found] == [0.0, 0.5] and found[0]["n_points"] > 7500 and not found[0]["bimodal"]
    assert abs(found[0]["result"].plane.d) < 5e-3 and abs(found[1]["result"].plane.d + 0.5) < 1e-2


def test_the_clicked_face_is_picked(spark):
    from facetspark.operators.extract import MainPlaneParams, PickParams, extract_main_plane, grown_plane, pick_plane_region

    rng = np.random.default_rng(13)
    face, far = patch(rng, 9000, 40), patch(rng, 12000, 40) + [200, 0, 0]
    wall = patch(rng, 4000, 40)[:, [2, 1, 0]] + [41, 0, 45]
    scene = cloud(spark, np.concatenate([face, far, wall]))
    p = PickParams(min_points_per_cell=1, min_neighbor_points=50, min_local_inliers=30, local_ransac_iterations=100, max_expand_rounds=3)
    members, plane = pick_plane_region(scene, (0.0, 0.0, 0.0), p)
    ids = [r["point_id"] for r in members.select("point_id").collect()]
    assert sum(i < 9000 for i in ids) > 8550 and not any(9000 <= i < 21000 for i in ids) and sum(i >= 21000 for i in ids) < 200
    assert np.degrees(np.arccos(plane.normal[2])) < 0.05
    _, table = grown_plane(scene, (0.0, 0.0, 0.0), planes.Plane.of((0.05, 0, 1), 0.0), p)
    assert [d.radius for d in table] == [10.0, 35.0, 60.0][: len(table)] and all(d.wider >= d.inside for d in table)
    main = extract_main_plane(scene, MainPlaneParams(min_points_per_cell=1, ransac_iterations=100), clicked=(0.0, 0.0, 0.0))
    assert main.members.filter("point_id >= 9000 AND point_id < 21000").isEmpty() and main.n_points > 8000
    with pytest.raises(ValueError):
        pick_plane_region(scene, (0.0, 0.0, 500.0), p)


def test_a_pipe_is_picked(spark):
    from facetspark.operators.extract import pick_around_cylinder, pick_ball_region, pick_cylinder_region

    rng = np.random.default_rng(14)
    a, t = rng.uniform(0, 2 * np.pi, 3000), rng.uniform(-200, 200, 3000)
    pipe = np.column_stack([30 * np.cos(a), 30 * np.sin(a), t]) + rng.normal(0, 0.05, (3000, 3))
    scene = cloud(spark, np.concatenate([pipe, patch(rng, 500, 100) + [0, 0, 150]]))
    # The axis of the first passes the click on the surface, so its shell meets the pipe on one side only.
    picks = (pick_cylinder_region(scene, (30.0, 0.0, 0.0), 100.0), 50), (pick_around_cylinder(scene, (0, 0, 0), (0, 0, 2), 30.0, 100.0), 500)
    for (got, _), least in picks:
        ids = np.array([r["point_id"] for r in got.select("point_id").collect()])
        assert (ids < 3000).all() and (np.abs(t[ids]) <= 41).all() and len(ids) >= least
    few, plane = pick_around_cylinder(scene, (0, 0, 0), (0, 0, 1), 500.0, 40.0)  # nothing at that radius: all of the ball
    assert few.count() == pick_ball_region(scene, (0.0, 0.0, 0.0), 40.0)[0].count() and plane is not None


def test_hypotheses_of_one_normal_share_a_projection():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.integers(-20, 20, (3000, 3)).astype(float), rng.normal(0, 30, (3000, 3)), [[1e9, -1e9, 5.0], [np.nan, 0.0, 0.0]]])
    normals = np.vstack([np.eye(3), rng.normal(size=(4, 3)), [[0.0, 0.0, 0.0]]])
    p = np.array([[*n, d] for n in normals for d in [*range(-12, 12), 0.1, 1e6, float("nan")]] + [[1.0, 2.0, 3.0, 0.5]])
    for threshold in (5.0, 0.25, 0.0):
        a = x[np.isfinite(x).all(axis=1)]
        want = [int((np.abs(a[:, 0] * q[0] + a[:, 1] * q[1] + a[:, 2] * q[2] + q[3]) <= threshold).sum()) for q in p]
        assert planes.count_inliers(iter([x[:2500], x[2500:]]), p, threshold).tolist() == want


def test_time_of_hypotheses_follows_their_normals():
    import time

    x = np.random.default_rng(4).normal(0, 50, (1 << 17, 3))
    p = np.array([[0.6, 0.0, 0.8, d] for d in np.linspace(-80, 80, 4000)])
    began = time.process_time()
    got = planes.count_inliers(iter([x[: 1 << 16], x[1 << 16 :]]), p, 5.0)
    assert time.process_time() - began < 0.5 and got.sum() > 1 << 17
