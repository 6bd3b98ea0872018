"""The kept index, the tables of points and inliers, and depth layers over many ranges."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from facetspark.functions.columns import Vec
from facetspark.operators import layers, planes, regions
from facetspark.sources import cloudindex, members


def cloud(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "point_id long, x double, y double, z double").repartition(4)


# --- the kept index ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    return np.vstack([rng.uniform(-100, 100, (20_000, 3)), rng.normal(50, 1, (2_000, 3)), np.zeros((3, 3))])


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("index"))
    return cloudindex.build_index(cloud(spark, points), path, 8.0, 16 << 10)


@pytest.mark.parametrize("center, radius", [((0, 0, 0), 20.0), ((50, 50, 50), 1.0), ((99, -99, 0), 35.0), ((500, 0, 0), 30.0), ((0, 0, 0), 1e4), ((0, 0, 0), 0.0)])
def test_balls_equal_brute_force(spark, points, index, center, radius):
    want = set(np.flatnonzero(((points - center) ** 2).sum(axis=1) <= radius * radius).tolist())
    assert {r["point_id"] for r in cloudindex.index_ball(spark, index, center, radius).collect()} == want
    centers = spark.createDataFrame([(7, *map(float, center))], "center_id long, x double, y double, z double")
    if radius < 100:
        assert {r["point_id"] for r in cloudindex.index_balls(spark, index, centers, radius).collect()} == want


def test_balls_are_written_as_runs_of_a_center(spark, tmp_path):
    """Such runs beside a repeated list of points take a fraction of the disk; one cell holds many copies of one point."""
    x = np.vstack([np.random.default_rng(8).uniform(0, 24, (12_000, 3)), np.full((1_000, 3), 12.0)])
    index = cloudindex.build_index(cloud(spark, x), f"file://{tmp_path}/index", 4.0)
    at = x[:12_000:100]
    centers = spark.createDataFrame([(100 * i, *map(float, c)) for i, c in enumerate(at)], "center_id long, x double, y double, z double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        cloudindex.index_balls(spark, index, centers, 16.0).write.parquet(f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs, got = 0, []
    for f in glob.glob(f"{tmp_path}/out/*.parquet"):
        t = pq.ParquetFile(f).read()
        c, p = t["center_id"].to_numpy(), t["point_id"].to_numpy()
        runs += 1 + np.count_nonzero(c[1:] != c[:-1])
        got += zip(c.tolist(), p.tolist(), strict=True)
    i, j = np.nonzero(((at[:, None] - x[None]) ** 2).sum(axis=2) <= 256)
    assert sorted(got) == sorted(zip((100 * i).tolist(), j.tolist(), strict=True))
    assert runs <= len(got) / 20


def test_balls_of_few_bytes_keep_all_tasks(spark, index):
    """Pairs grow with the square of a cloud, so partitions of few bytes are not united."""
    centers = index.points(spark).filter("point_id % 100 = 0").withColumnRenamed("point_id", "center_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        assert cloudindex.index_balls(spark, index, centers, 16.0).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tiles_are_bounded(spark):
    rows = spark.range(0, 5_000, 1, 3).selectExpr("id DIV 2000 AS k", "id AS point_id", "CAST(id AS DOUBLE) AS x", "0.0D AS y", "-1.0D AS z")
    got = regions.tiles(rows, ["k"]).collect()
    assert sorted(p["point_id"] for r in got for p in r["points"]) == list(range(5_000))
    assert max(len(r["points"]) for r in got) == regions.TILE_POINTS and len(got) < 60
    for r in got:
        x = [p["x"] for p in r["points"]]
        assert (r["x0"], r["x1"], r["y0"], r["z1"]) == (min(x), max(x), 0.0, -1.0) and {int(v) // 2000 for v in x} == {r["k"]}


def test_a_ball_reads_few_row_groups(spark, points, index):
    low, high = [tuple(int((c - o + s * 10) // index.cell) for c, o in zip((0, 0, 0), index.low, strict=True)) for s in (-1, 1)]
    ranges = cloudindex.key_ranges(low, high)
    total = hit = 0
    for f in glob.glob(index.path.removeprefix("file://") + "/points/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == "key")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            total += 1
            hit += any(a <= s.max and s.min <= b for a, b in ranges)
    assert total >= 20 and hit <= total / 3
    plan = cloudindex.index_ball(spark, index, (0, 0, 0), 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "Or(" in plan.split("PushedFilters: ", 1)[1]


def test_key_ranges_cover_the_box():
    code = lambda c: sum(((c[i] >> b) & 1) << (3 * b + 2 - i) for b in range(cloudindex.BITS) for i in range(3))
    rng = np.random.default_rng(0)
    for most in (1, 8, 64):
        for _ in range(20):
            low = rng.integers(0, 60, 3)
            high = low + rng.integers(0, 9, 3)
            ranges = cloudindex.key_ranges(tuple(map(int, low)), tuple(map(int, high)), most)
            assert ranges == sorted(ranges) and all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
            for corner in np.ndindex(*(high - low + 1)):
                k = code([int(v) for v in low + corner])
                assert any(a <= k <= b for a, b in ranges)
    assert cloudindex.key_ranges((5, 5, 5), (4, 9, 9)) == []


def test_an_index_is_kept_while_it_fits(spark, points, tmp_path):
    path = "file://" + str(tmp_path / "kept")
    some = cloud(spark, points[:500])
    assert cloudindex.open_index(spark, path) is None
    first = cloudindex.kept_index(some, path, 5.0)
    stamp = sorted(glob.glob(str(tmp_path / "kept" / "points" / "*.parquet")))
    assert cloudindex.kept_index(some, path, 5.0) == first and sorted(glob.glob(str(tmp_path / "kept" / "points" / "*.parquet"))) == stamp
    assert cloudindex.open_index(spark, path, cell=6.0) is None
    moved = points[:500].copy()
    moved[17, 2] += 1e-9
    assert cloudindex.open_index(spark, path, cloudindex.cloud_fingerprint(cloud(spark, moved))) is None
    assert cloudindex.kept_index(cloud(spark, moved), path, 5.0).fingerprint != first.fingerprint
    with pytest.raises(ValueError, match="larger cell"):
        cloudindex.build_index(some, path, 1e-6)
    none = cloudindex.build_index(some.filter("point_id < 0"), path, 1.0)
    assert cloudindex.index_ball(spark, none, (0, 0, 0), 5.0).count() == 0


# --- points and inliers ------------------------------------------------------------------------


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_inliers_by_ids_and_by_numbers(spark, tmp_path):
    store = "file://" + str(tmp_path)
    members.save_points(store, spark.createDataFrame([(g, i, float(i), 0.0, 0.0) for g in (1, 2) for i in (40, 10, 30, 20)] + [(1, 10, 9.0, 0.0, 0.0)], "group_id long, point_id long, x double, y double, z double"))
    assert rows(members.load_points(spark, store).filter("group_id = 1").select("local_idx", "point_id", "x")) == [(0, 10, 9.0), (1, 20, 20.0), (2, 30, 30.0), (3, 40, 40.0)]
    entity = "group_id long, kind string, entity int"
    entities = spark.createDataFrame([(1, "plane", 0), (1, "plane", 1), (1, "circle", 0), (2, "cylinder", 0)], entity)
    source = spark.createDataFrame([(1, "plane", 0, 20), (1, "plane", 0, 99), (2, "cylinder", 0, 10), (2, "cylinder", 0, 10), (5, "plane", 0, 1)], entity + ", point_id long")
    local = spark.createDataFrame([(1, "plane", 0, 3), (1, "plane", 1, 0), (1, "plane", 1, 2)], entity + ", local_idx long")
    n = members.save_inliers(store, entities, source, local)
    assert rows(n) == [(1, "circle", 0, 0), (1, "plane", 0, 2), (1, "plane", 1, 2), (2, "cylinder", 0, 1)]
    got = sorted(members.load_inliers(spark, store).collect(), key=lambda r: (r[0], r[1], r[2], r[3]))
    # Ids win over numbers; a fit with an id that its group does not have has no numbers.
    assert [tuple(r) for r in got] == [(1, "plane", 0, 20, None), (1, "plane", 0, 99, None), (1, "plane", 1, 10, 0), (1, "plane", 1, 30, 2), (2, "cylinder", 0, 10, 0)]
    # A new save of group 1 drops what it had of other fits, and leaves group 2.
    members.save_inliers(store, spark.createDataFrame([(1, "plane", 3)], entity), spark.createDataFrame([(1, "plane", 3, 40)], entity + ", point_id long"))
    assert rows(members.load_inliers(spark, store)) == [(1, "plane", 3, 40, 3), (2, "cylinder", 0, 10, 0)]
    members.save_inliers(store, spark.createDataFrame([(1, "plane", 3)], entity))
    assert rows(members.load_inliers(spark, store)) == [(2, "cylinder", 0, 10, 0)]
    for bad in (-1, 4):
        with pytest.raises(ValueError, match="out of range"):
            members.save_inliers(store, entities, None, spark.createDataFrame([(2, "cylinder", 0, bad)], entity + ", local_idx long"))


def test_index_files_of_a_project(spark, tmp_path):
    np.save(tmp_path / "group_003_indices.npy", np.array([9, 4, 7], dtype=np.int64))
    np.save(tmp_path / "group_003_p0_indices.npy", np.array([4], dtype=np.int32))
    np.save(tmp_path / "group_012_cyl2_indices.npy", np.arange(250_000))
    np.save(tmp_path / "other.npy", np.arange(5))
    got = members.read_index_files(spark, "file://" + str(tmp_path))
    assert sorted(map(tuple, got.filter("group_id = 3").collect()), key=str) == sorted([(3, None, None, 0, 9), (3, None, None, 1, 4), (3, None, None, 2, 7), (3, "plane", 0, 0, 4)], key=str)
    big = got.filter("group_id = 12").agg(F.count("*"), F.sum("point_id"), F.max(F.col("place") - F.col("point_id")), F.first("kind"), F.first("entity")).first()
    assert tuple(big) == (250_000, 250_000 * 249_999 // 2, 0, "cylinder", 2)
    names = members.fit_names(spark.createDataFrame([(3, "plane", 0), (3, "cylinder", 1), (4, "circle", 2)], "group_id long, kind string, entity int"))
    assert [r["name"] for r in names.orderBy("group_id", "entity").collect()] == ["G3_p0", "G3_cyl1", "G4_cir2"]


# --- depth layers ------------------------------------------------------------------------------


def plain_layers(t, gap, least, low=8.0):
    t = sorted(t)
    steps = [b[0] - a[0] for a, b in zip(t, t[1:], strict=False)]
    cut = gap if gap is not None else max(low, 10 * float(np.median(steps)) if steps else 0.0)
    out, run = [], []
    for i, p in enumerate(t):
        if i and steps[i - 1] > cut:
            out.append(run)
            run = []
        run.append(p)
    out = [r for r in [*out, run] if len(r) >= least]
    return [(k, r[0][1], pytest.approx(np.mean([x for x, _ in r])), len(r)) for k, r in enumerate(out)]


@pytest.mark.parametrize("gap, least", [(0.5, 1), (None, 2), (1e9, 1), (0.0, 1)])
def test_layers_across_ranges(spark, gap, least):
    """One group far larger than a range, whose layers cross the ranges' borders."""
    rng = np.random.default_rng(6)
    big = [(float(v), i) for i, v in enumerate(np.sort(np.concatenate([rng.normal(c, 0.2, 150) for c in (0, 5, 40, 41, 300)])))]
    big += [(big[-1][0], 10_000 + i) for i in range(40)]  # ties
    groups = {"big": big, "one": [(3.0, 7)], None: [(0.0, 1), (0.2, 2), (9.0, 3)]}
    df = spark.createDataFrame([(g, i, t) for g, rows_ in groups.items() for t, i in rows_], "g string, point_id long, t double").repartition(5)
    got = {}
    for r in layers.depth_layers(df, ["g"], gap, least, 0.01).orderBy("g", "layer").collect():
        got.setdefault(r["g"], []).append((r["layer"], r["seed_id"], r["depth"], r["n_points"]))
    want = {g: plain_layers(x, gap, least, 0.01) for g, x in groups.items()}
    assert got == {g: x for g, x in want.items() if x}
    alone = [(r["layer"], r["seed_id"], r["depth"], r["n_points"]) for r in layers.depth_layers(df.filter("g = 'big'"), [], gap, least, 0.01).orderBy("layer").collect()]
    assert alone == want["big"]


def test_front_layers_widen_until_there_is_enough(spark):
    rng = np.random.default_rng(2)
    wall = np.column_stack([rng.uniform(-8, 8, (400, 2)), np.full(400, 50.0) + rng.normal(0, 0.1, 400)])
    wire = np.column_stack([rng.uniform(-0.5, 0.5, (8, 2)), np.full(8, 10.0)])
    df = cloud(spark, np.vstack([wall, wire]))
    got = layers.front_layers(df, Vec.of(0, 0, 0), Vec.of(0, 0, 1), 1.0, enough=15).orderBy("layer").collect()
    assert [round(r["depth"]) for r in got] == [10, 50]  # the wire never has fifteen points: the longest list
    front = layers.front_layers(df.filter("z > 20"), Vec.of(0, 0, 0), Vec.of(0, 0, 1), 1.0, enough=15).collect()
    assert len(front) == 1 and 15 <= front[0]["n_points"] < 100
    assert layers.front_layers(df, Vec.of(0, 0, 99), Vec.of(0, 0, 1), 1.0).count() == 0


# --- hypotheses --------------------------------------------------------------------------------


def test_hypotheses_in_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(-50, 50, (700, 3)))
    n = rng.integers(-3, 4, (130, 3)).astype(float)
    hyp = spark.createDataFrame([(i, *map(float, v), float(i % 9)) for i, v in enumerate(n)], "hyp_id long, nx double, ny double, nz double, d double")
    want = {i: int((np.abs(x @ v + i % 9) <= 5.0).sum()) for i, v in enumerate(n)}  # many ties at the threshold
    for block in (7, 130, 1000):
        assert {r["hyp_id"]: r["inliers"] for r in planes.score_hypotheses(cloud(spark, x), hyp, 5.0, block).collect()} == want


def test_best_hypothesis_counts_the_whole_cloud(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 100, (3000, 2))
    x = np.column_stack([xy, 0.1 * xy[:, 0] + rng.normal(0, 0.02, 3000)])
    x[::5, 2] += rng.uniform(2, 9, 600)
    df = cloud(spark, x)
    plane, hits = planes.ransac_plane(df, 0.1, 200, pool=500)
    assert 2200 < hits <= 2400 and plane.angle_to(planes.Plane.of((0.1, 0, -1), 0)) < 5e-3
    assert hits == df.filter(F.abs(plane.signed()) <= 0.1).count()
    with pytest.raises(ValueError):
        planes.ransac_plane(df.limit(2), 0.1)
