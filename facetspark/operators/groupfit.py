"""Fits of many groups of points in one loop: robust planes, main faces, several faces, pipes.

What a loop knows of a group is a row of a state table (plane, threshold, done).  A round joins
the open rows to the cloud and takes one aggregate by group, so that the number of jobs follows
the slowest group's rounds and not the number of groups; finished groups leave the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Vec, inplane_basis
from ..scratch import materialize
from .extract import MainPlaneParams, MultiPlaneParams
from .planes import eigen_rows, moment_columns
from .quantiles import group_mad, join_groups
from .regions import component_roots
from .rounds import RoundParams, fit_cylinders

_PLANE = ("nx", "ny", "nz", "d")


def _distance(p: Vec, names: tuple[str, ...] = _PLANE) -> Column:
    return F.col(names[0]) * p.x + F.col(names[1]) * p.y + F.col(names[2]) * p.z + F.col(names[3])


_P = ("x", "y", "z")


def robust_planes(
    cloud: DataFrame, key: str, threshold: float | None = None, sigma_factor: float = 3.0, max_iterations: int = 50,
    init: DataFrame | None = None, min_inlier_fraction: float = 0.1, few: int = 20_000,
) -> DataFrame:
    """A robust plane of each group: (key, n, nx, ny, nz, d, threshold, converged, n_iterations, n_inliers, status).

    The refits of ``robust_fit_plane``, for all groups at once: a group's points within
    the threshold are fitted again until they stay the same.  A threshold that is None is
    each group's own, ``sigma_factor`` times the median deviation of its current inliers.
    ``init`` (key, nx, ny, nz, d) starts groups from given planes, the others from their
    least-squares plane.  status is ok, not_converged, too_few_points, threshold_collapsed
    or too_few_inliers; the plane of a group that failed is its last one.
    """
    kind = dict(cloud.dtypes)[key]
    cloud = cloud.filter(F.col(key).isNotNull()).select(key, *_P)
    start = eigen_rows(cloud.groupBy(key).agg(*moment_columns()), key, 0).select(key, "n", *(F.col(a).alias(b) for a, b in zip(("vx", "vy", "vz", "d"), _PLANE, strict=True)))
    if init is not None:
        given = init.select(key, *(F.col(c).alias(f"g{c}") for c in _PLANE))
        start = start.join(given, key, "left").select(key, "n", *(F.coalesce(f"g{c}", c).alias(c) for c in _PLANE))
    null = F.lit(None).cast("double")
    enough = (F.col("n") >= 3) & F.col("nx").isNotNull()
    state = start.select(
        key, "n", *_PLANE, *(null.alias(f"o{c}") for c in _PLANE), null.alias("othr"), F.lit(threshold).cast("double").alias("thr"),
        F.when(enough, F.lit(None)).otherwise("too_few_points").alias("status"), F.lit(0).alias("its"), F.lit(None).cast("long").alias("n_in"),
    )
    state = materialize(state, "planes-state")
    columns = state.columns
    most, open_ = state.agg(F.max("n"), F.count_if(F.col("status").isNull())).first()
    finished = [state.filter("status is not null")]
    live = state.filter("status is null")
    p = Vec.cols(*_P)
    for it in range(1, max_iterations + 1):
        if not open_:
            break
        rows = cloud.join(live, key)
        was = F.lit(True) if it == 1 else F.abs(_distance(p, tuple(f"o{c}" for c in _PLANE))) <= F.col("othr")
        if threshold is None:
            sigma = group_mad(rows.filter(was), [key], _distance(p), "sigma", most, few).select(key, (F.col("sigma") * sigma_factor).alias("thr"))
            sigma = materialize(sigma, "planes-sigma")
            live = live.drop("thr").join(sigma, key, "left").select(columns)
            rows = rows.drop("thr").join(sigma, key, "left")
        now = F.coalesce(F.abs(_distance(p)) <= F.col("thr"), F.lit(False))
        got = rows.groupBy(key).agg(F.sum((now != was).cast("long")).alias("changed"), F.first("thr").alias("thr"), *moment_columns(now))
        got = materialize(got, "planes-sums")
        fit = eigen_rows(got, key, 0).select(key, *(F.col(a).alias(f"f{b}") for a, b in zip(("vx", "vy", "vz", "d"), _PLANE, strict=True)))
        seen = live.drop("thr").join(got.select(key, "changed", "thr", F.col("n").alias("n_now")), key).join(fit, key)
        sound = (F.col("thr") > 0) & (F.col("thr") < float("inf"))
        few_in = F.col("n_now") < F.greatest(F.lit(3), (min_inlier_fraction * F.col("n")).cast("int"))
        same = (F.col("changed") == 0) & F.lit(it > 1)
        status = F.when(~F.coalesce(sound, F.lit(False)), "threshold_collapsed").when(few_in, "too_few_inliers").when(same, "ok")
        ended = status.isNotNull()
        seen = seen.select(
            key, "n", *(F.when(ended, F.col(c)).otherwise(F.col(f"f{c}")).alias(c) for c in _PLANE), *(F.col(c).alias(f"o{c}") for c in _PLANE),
            F.col("thr").alias("othr"), "thr", F.coalesce(status, F.lit("not_converged") if it == max_iterations else F.lit(None)).alias("status"), F.lit(it).alias("its"), F.col("n_now").alias("n_in"),
        )
        seen = materialize(seen, "planes-state")
        open_ = seen.filter("status is null").count()
        finished.append(seen.filter("status is not null"))
        live = seen.filter("status is null")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    out = materialize(out, "planes-fits")
    count = cloud.join(out.select(key, *_PLANE, "thr"), key).filter(F.abs(_distance(p)) <= F.col("thr")).groupBy(key).agg(F.count("*").alias("n_inliers"))
    return out.join(count, key, "left").select(
        F.col(key).cast(kind).alias(key), "n", *_PLANE, F.col("thr").alias("threshold"), (F.col("status") == "ok").alias("converged"),
        F.col("its").alias("n_iterations"), F.coalesce("n_inliers", F.lit(0)).alias("n_inliers"), "status",
    )


def bounded_planes(cloud: DataFrame, key: str, p: MainPlaneParams, init: DataFrame) -> DataFrame:
    """Adaptive fits from given planes; groups whose threshold passes the ceiling are done again with the ceiling."""
    cloud = cloud.join(init.select(key), key, "left_semi")
    first = materialize(robust_planes(cloud, key, None, p.sigma_factor, p.max_iterations, init, 0.0), "planes-first")
    over = first.filter(F.col("threshold") > p.max_threshold_mm).select(key)
    if over.isEmpty():
        return first
    again = robust_planes(cloud.join(over, key, "left_semi"), key, p.max_threshold_mm, p.sigma_factor, p.max_iterations, init, 0.0)
    return materialize(first.join(over, key, "left_anti").unionByName(again), "planes-bounded")


def seed_planes(cloud: DataFrame, key: str, p: MainPlaneParams, pool: int = 100_000) -> DataFrame:
    """(key, nx, ny, nz, d): of each group the three-point plane with most points of its pool within the threshold.

    A group's pool is a hashed share of its points, about ``pool`` of them; one task tries
    and scores a group's hypotheses on it.  Groups without three points apart have no row.
    """
    kind = dict(cloud.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        x = pdf[list(_P)].to_numpy(dtype=np.float64)
        empty = pd.DataFrame({key: np.empty(0, dtype=object), **{c: np.empty(0) for c in _PLANE}})
        if len(x) < 3:
            return empty
        pick = np.random.default_rng(p.seed).integers(0, len(x), (p.ransac_iterations, 3))
        a, b, c = (x[pick[:, i]] for i in range(3))
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n, axis=1)
        ok = size > 1e-12
        if not ok.any():
            return empty
        n, a = n[ok] / size[ok, None], a[ok]
        d = -(n * a).sum(axis=1)
        score = np.zeros(len(d), dtype=np.int64)
        for i in range(0, len(x), 8192):
            score += (np.abs(x[i : i + 8192] @ n.T + d) <= p.ransac_threshold_mm).sum(axis=0)
        best = int(score.argmax())
        sign = -1.0 if n[best][np.abs(n[best]).argmax()] < 0 else 1.0
        return pd.DataFrame([[pdf[key].iloc[0], *(sign * n[best]), sign * d[best]]], columns=[key, *_PLANE])

    sizes = materialize(cloud.groupBy(key).agg(F.count("*").alias("n__")), "faces-counts")
    share = F.pmod(F.xxhash64("point_id", F.lit(p.seed)), F.ceil(F.col("n__") / pool)) == 0
    return cloud.select(key, "point_id", *_P).join(sizes, key).filter(share).drop("n__").groupBy(key).applyInPandas(run, f"{key} {kind}, nx double, ny double, nz double, d double")


def connected_points(inliers: DataFrame, key: str, planes: DataFrame, p: MainPlaneParams, clicks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The points of each group's main in-plane component, and (key, components, share, reasons).

    One grid a group, about the mean of its points; cells below the least number are
    dropped.  The main component is the clicked one, else that of most points.  A group
    without an occupied cell keeps all its points.
    """
    plane = planes.select(key, "nx", "ny", "nz")
    mean = inliers.groupBy(key).agg(*[F.avg(c).alias(f"m{c}") for c in _P])
    u, v = inplane_basis(Vec.cols("nx", "ny", "nz"))
    rel = Vec.cols(*_P) - Vec.cols("mx", "my", "mz")
    frame = materialize(plane.join(mean, key), "faces-frames")
    uv = inliers.select(key, "point_id", *_P).join(frame, key).withColumns({"u": rel.dot(u), "v": rel.dot(v)})
    low = materialize(uv.groupBy(key).agg(F.min("u").alias("u0"), F.min("v").alias("v0"), F.count("*").alias("all")).join(frame, key), "faces-low")
    at = {i: F.floor((F.col(c) - F.col(f"{c}0")) / p.cell_size_mm).cast("long") for i, c in (("iu", "u"), ("iv", "v"))}
    spots = materialize(uv.select(key, "point_id", *_P, "u", "v").join(low.select(key, "u0", "v0"), key).withColumns(at).select(key, "point_id", *_P, "iu", "iv"), "faces-spots")
    cells = spots.groupBy(key, "iu", "iv").agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= p.min_points_per_cell)
    cells = materialize(cells, "faces-cells")
    roots = component_roots(cells, [key])
    roots = materialize(roots.join(cells, [key, "iu", "iv"]), "faces-roots")
    parts = roots.groupBy(key, "ru", "rv").agg(F.sum("cnt").alias("size"))
    best = parts.groupBy(key).agg(F.max(F.struct("size", (-F.col("ru")).alias("a"), (-F.col("rv")).alias("b"))).alias("top"), F.count("*").alias("components"))
    main = best.select(key, "components", F.col("top.size").alias("size"), (-F.col("top.a")).alias("ru"), (-F.col("top.b")).alias("rv")).withColumn("missed", F.lit(False))
    if clicks is not None:
        q = Vec.cols("cx", "cy", "cz") - Vec.cols("mx", "my", "mz")
        hit = clicks.filter("cx is not null").select(key, "cx", "cy", "cz").join(low, key).withColumns({"u": q.dot(u), "v": q.dot(v)}).withColumns(at).select(key, "iu", "iv")
        hit = hit.join(roots.select(key, "iu", "iv", "ru", "rv"), [key, "iu", "iv"], "left").select(key, F.col("ru").alias("hu"), F.col("rv").alias("hv"))
        hit = hit.join(parts.select(key, F.col("ru").alias("hu"), F.col("rv").alias("hv"), F.col("size").alias("hsize")), [key, "hu", "hv"], "left").withColumn("asked", F.lit(True))
        main = main.join(hit, key, "left").select(
            key, "components", F.coalesce("hsize", "size").alias("size"), F.coalesce("hu", "ru").alias("ru"), F.coalesce("hv", "rv").alias("rv"), (F.col("asked") & F.col("hu").isNull()).alias("missed")
        )
    main = materialize(main, "faces-main")
    chosen = roots.join(main.select(key, "ru", "rv"), [key, "ru", "rv"]).select(key, "iu", "iv")
    inside = spots.join(chosen, [key, "iu", "iv"], "left_semi")
    bare = spots.join(main.select(key), key, "left_anti")
    reasons = F.when(F.col("components").isNull(), F.array(F.lit("no_occupied_cells"))).when(F.col("missed"), F.array(F.lit("click_not_on_component_using_largest"))).otherwise(F.array().cast("array<string>"))
    report = low.select(key, "all").join(main, key, "left").select(
        key, F.coalesce("components", F.lit(0)).cast("int").alias("components"), F.coalesce(F.col("size") / F.col("all"), F.lit(1.0)).alias("share"), reasons.alias("reasons")
    )
    return materialize(inside.unionByName(bare).select(key, "point_id", *_P), "faces-points"), materialize(report, "faces-report")


def main_planes(cloud: DataFrame, key: str, params: MainPlaneParams = MainPlaneParams(), hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The main face of each group: a row a group, and the points (key, point_id, x, y, z) of each face.

    What ``extract_main_plane`` does with one cloud, for all groups side by side: a seed,
    bounded refits, the main component, bounded refits of it, gates.  ``hints`` may have a
    coarse plane (nx, ny, nz, d) and a click (cx, cy, cz) of a group, or nulls.  Rows are
    (key, nx, ny, nz, d, threshold, n_points, components, share, mad_sigma, status, reasons);
    a group without any plane is ``fail`` with the reason ``no_plane``.
    """
    least = max(3, params.min_points)
    cloud = cloud.filter(F.col(key).isNotNull()).select(key, "point_id", *_P)
    sizes = cloud.groupBy(key).agg(F.count("*").alias("all"))
    names = [key, *_PLANE]
    coarse = hints.filter("nx is not null").select(names).join(sizes, key) if hints is not None else None
    given = coarse.filter(F.col("all") >= params.skip_ransac_min_points).select(names) if coarse is not None else None
    tried = seed_planes(cloud if given is None else cloud.join(given, key, "left_anti"), key, params)
    seeds = tried
    if coarse is not None:
        tried = materialize(tried, "faces-tried")
        seeds = tried.unionByName(coarse.select(names).join(tried, key, "left_anti"))
    seeds = materialize(seeds, "faces-seeds")
    p = Vec.cols(*_P)

    def kept(points: DataFrame, init: DataFrame) -> tuple[DataFrame, DataFrame]:
        fits = materialize(bounded_planes(points, key, params, init), "faces-fits")
        near = points.join(fits.select(*names, "threshold"), key).filter(F.abs(_distance(p)) <= F.col("threshold"))
        return fits, materialize(near.select(key, "point_id", *_P), "faces-inliers")

    fits, inliers = kept(cloud, seeds)
    small = fits.filter(F.col("n_inliers") < least)
    go_on = fits.filter(F.col("n_inliers") >= least)
    points, report = connected_points(inliers.join(go_on.select(key), key, "left_semi"), key, go_on, params, hints)
    size = materialize(points.groupBy(key).agg(F.count("*").alias("part")).join(report, key), "faces-sizes")
    thin = size.filter((F.col("components") == 0) | (F.col("part") < least))
    firm = size.join(thin.select(key), key, "left_anti")
    last, final = kept(points.join(firm.select(key), key, "left_semi"), go_on.join(firm.select(key), key, "left_semi").select(names))
    strings = F.array().cast("array<string>")
    early = small.join(seeds.select(key), key).select(*names, "threshold", "status", F.array(F.when(F.col("status").isin("threshold_collapsed", "too_few_points"), F.col("status")).otherwise("too_few_inliers_after_refit")).alias("reasons")).withColumns({"components": F.lit(None).cast("int"), "share": F.lit(None).cast("double")})
    thin = go_on.join(thin, key).select(*names, "threshold", "status", F.concat("reasons", F.when(F.col("components") > 0, F.array(F.lit("main_component_too_small"))).otherwise(strings)).alias("reasons"), "components", "share")
    graded = last.join(firm, key).select(*names, "threshold", "status", "reasons", "components", "share")
    every = early.withColumn("stage", F.lit(0)).unionByName(thin.withColumn("stage", F.lit(1))).unionByName(graded.withColumn("stage", F.lit(2)))
    every = materialize(every, "faces-all")
    stage = every.select(key, "stage")
    members = inliers.join(stage.filter("stage = 0"), key, "left_semi").unionByName(points.join(stage.filter("stage = 1"), key, "left_semi")).unionByName(final)
    members = materialize(members, "faces-members")
    rows = members.join(every.select(names), key)
    sigma = group_mad(rows, [key], _distance(p))
    count = members.groupBy(key).agg(F.count("*").alias("n_points"))
    found = every.join(sigma, key, "left").join(count, key, "left").na.fill(0, ["n_points"])
    over = lambda limit: F.col("mad_sigma").isNull() | (F.col("mad_sigma") > limit)
    gates = [
        (F.col("status") != "ok", "not_converged"), (F.col("share") < params.min_main_fraction, "main_component_minor_fraction"),
        (over(params.ok_mad_sigma_mm), "mad_sigma_above_ok"), (over(params.fail_mad_sigma_mm), "mad_sigma_above_fail"),
    ]
    hits = F.filter(F.array(*[F.when(test, F.lit(reason)) for test, reason in gates]), lambda x: x.isNotNull())
    final_ = F.col("stage") == 2
    status = F.when(~final_ | F.array_contains(hits, "mad_sigma_above_fail"), "fail").when(F.size(hits) > 0, "suspect").otherwise("ok")
    table = found.select(
        *names, "threshold", "n_points", "components", "share", "mad_sigma", status.alias("status"), F.when(final_, F.concat("reasons", hits)).otherwise(F.col("reasons")).alias("reasons")
    )
    bare = sizes.select(key).join(seeds.select(key), key, "left_anti")
    bare = bare.select(key, *[F.lit(None).cast("double").alias(c) for c in (*_PLANE, "threshold")], F.lit(0).cast("long").alias("n_points"), F.lit(None).cast("int").alias("components"), F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("mad_sigma"), F.lit("fail").alias("status"), F.array(F.lit("no_plane")).alias("reasons"))
    return materialize(table.unionByName(bare), "faces-table"), members


def group_bimodality(rows: DataFrame, key: str, residual: Column, sigma: DataFrame, bins: int = 81) -> DataFrame:
    """(key, bimodal): has a group's residual histogram over 6 sigma a second peak, as ``bimodality`` asks of one cloud?

    ``sigma`` is (key, sigma).  The histogram has at most ``bins`` rows a group.
    """
    s = F.col("sigma")
    r = rows.select(key, residual.alias("r")).join(sigma.select(key, F.col("sigma").alias("sigma")), key).filter(s > 0)
    spot = F.least(F.floor((F.col("r") + 6 * s) / (12 * s) * bins), F.lit(bins - 1)).cast("int")
    hist = r.filter(F.abs("r") <= 6 * s).groupBy(key, "sigma", spot.alias("bin")).agg(F.count("*").alias("cnt"))
    groups = r.groupBy(key, "sigma").agg(F.count("*").alias("n"))
    full = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(hist.drop("sigma"), [key, "bin"], "left").na.fill(0, ["cnt"])
    order = Window.partitionBy(key).orderBy("bin")
    full = full.withColumn("top", F.max("cnt").over(order.rowsBetween(-2, 2)))
    peak = F.max(F.struct("cnt", (-F.col("bin")).alias("b"))).over(Window.partitionBy(key))
    full = full.withColumn("peak", peak)
    second = (F.abs(F.col("bin") + F.col("peak.b")) * (12 * s / bins) > 2 * s) & (F.col("cnt") > 0.3 * F.col("peak.cnt")) & (F.col("cnt") == F.col("top"))
    return full.groupBy(key).agg((F.max(second.cast("int")) == 1).alias("two"), F.first("n").alias("n")).select(key, ((F.col("n") >= 1000) & F.col("two")).alias("bimodal"))


@dataclass(frozen=True)
class GroupFitParams:
    """Ceilings in mm: an adaptive threshold of a plane never passes ``max_threshold_mm`` here."""

    max_threshold_mm: float = 0.5
    plane: MainPlaneParams = MainPlaneParams()
    multi: MultiPlaneParams = MultiPlaneParams()
    cylinder: RoundParams = RoundParams()


_ENTITY = ("kind", "entity", "nx", "ny", "nz", "d", "px", "py", "pz", "ux", "uy", "uz", "diameter_mm", "n_points", "status", "reasons", "bimodal", "mad_sigma_mm", "threshold_mm")


def _faces(cloud: DataFrame, key: str, p: MainPlaneParams, hints: DataFrame | None, number: int) -> tuple[DataFrame, DataFrame]:
    table, members = main_planes(cloud, key, p, hints)
    two = group_bimodality(members.join(table.select(key, *_PLANE), key), key, _distance(Vec.cols(*_P)), table.select(key, F.col("mad_sigma").alias("sigma")))
    null = F.lit(None).cast("double")
    rows = table.join(two, key, "left").select(
        key, F.lit("plane").alias("kind"), F.lit(number).alias("entity"), *_PLANE, *(null.alias(c) for c in _ENTITY[6:13]), "n_points", "status", "reasons",
        F.coalesce("bimodal", F.lit(False)).alias("bimodal"), F.col("mad_sigma").alias("mad_sigma_mm"), F.col("threshold").alias("threshold_mm"),
    )
    return rows, members


def _many_faces(cloud: DataFrame, key: str, p: MultiPlaneParams, hints: DataFrame | None) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Faces of all groups in turn, from what earlier ones left of each; a group leaves when its list ends."""
    one = replace(p.plane, min_points=min(p.plane.min_points, p.min_plane_points))
    rest = cloud.select(key, "point_id", *_P)
    whole = rest.groupBy(key).agg(F.count("*").alias("whole"))
    for k in range(p.max_planes):
        left = rest.groupBy(key).agg(F.count("*").alias("left")).join(whole, key)
        open_ = left.filter((F.col("left") >= max(p.min_plane_points, 3)) & (F.col("left") >= p.min_remaining_fraction * F.col("whole"))).select(key)
        rest = materialize(rest.join(materialize(open_, "faces-open"), key, "left_semi"), "faces-rest")
        if rest.isEmpty():
            return
        rows, members = _faces(rest, key, one, hints if k == 0 else None, k)
        # A face too small ends a list, and so does a failed one, which is listed only if it is the first.
        keep = (F.col("n_points") >= p.min_plane_points) & ~F.array_contains("reasons", "no_plane")
        if k:
            keep = keep & (F.col("status") != "fail")
        rows = materialize(rows.filter(keep), "faces-kept")
        members = members.join(rows.select(key), key, "left_semi")
        yield rows, members
        go_on = rows.filter("status <> 'fail'").select(key)
        rest = rest.join(go_on, key, "left_semi").join(members.select(key, "point_id"), [key, "point_id"], "left_anti")


def fit_groups(cloud: DataFrame, key: str, groups: DataFrame, params: GroupFitParams = GroupFitParams()) -> tuple[DataFrame, DataFrame]:
    """Fits of all groups by their kind, and the inliers (key, kind, entity, point_id) of every fit.

    ``groups`` is (key, fit) with fit ``plane``, ``multi`` or ``cylinder``, and optionally a
    coarse plane (nx, ny, nz, d), a click (cx, cy, cz) and, for cylinders, the columns of
    ``cloud`` that ``fit_cylinders`` needs.  A row of the first result is a fitted entity:
    plane 0 of a ``plane`` group, planes 0, 1, ... of a ``multi`` group, cylinder 0 of a
    ``cylinder`` group.  All groups of a kind are fitted side by side.  A group that is
    not in ``groups`` is not fitted; one without points has no row.
    """
    kinds = dict(groups.dtypes)
    extra = [F.lit(None).cast("double").alias(c) if c not in kinds else F.col(c) for c in (*_PLANE, "cx", "cy", "cz")]
    groups = materialize(groups.select(key, "fit", *extra), "fit-groups")
    cloud = materialize(cloud.select(key, "point_id", *_P).join(groups.select(key, "fit"), key), "fit-cloud")
    one = replace(params.plane, max_threshold_mm=params.max_threshold_mm)
    many = replace(params.multi, plane=replace(params.multi.plane, max_threshold_mm=params.max_threshold_mm))
    present = {r["fit"] for r in groups.select("fit").distinct().limit(4).collect()}
    if unknown := present - {"plane", "multi", "cylinder"}:
        raise ValueError(f"unknown kind of fit: {sorted(map(str, unknown))}")
    own = lambda fit: (cloud.filter(F.col("fit") == fit).drop("fit"), groups.filter(F.col("fit") == fit))
    found: list[tuple[DataFrame, DataFrame]] = []
    if "plane" in present:
        points, hints = own("plane")
        found.append(_faces(points, key, one, hints, 0))
    if "multi" in present:
        points, hints = own("multi")
        found += _many_faces(points, key, many, hints)
    fits = [rows for rows, _ in found]
    inliers = [members.join(rows.select(key, "kind", "entity"), key).select(key, "kind", "entity", "point_id") for rows, members in found]
    if "cylinder" in present:
        points, _ = own("cylinder")
        pipes = materialize(fit_cylinders(points, key, params.cylinder), "fit-pipes")
        null = F.lit(None).cast("double")
        fits.append(pipes.select(
            key, F.lit("cylinder").alias("kind"), F.lit(0).alias("entity"), *(null.alias(c) for c in _PLANE), "px", "py", "pz", "ux", "uy", "uz", "diameter_mm",
            F.coalesce("n_inliers", F.lit(0)).alias("n_points"), "status", F.array().cast("array<string>").alias("reasons"), F.lit(False).alias("bimodal"), "mad_sigma_mm", "threshold_mm",
        ))
        w = Vec.cols(*_P) - Vec.cols("px", "py", "pz")
        t = w.dot(Vec.cols("ux", "uy", "uz"))
        off = F.sqrt(F.greatest(w.norm2() - t * t, F.lit(0.0))) - F.col("diameter_mm") / 2
        near = points.join(pipes, key).filter(F.abs(off) <= F.col("threshold_mm"))
        inliers.append(near.select(key, F.lit("cylinder").alias("kind"), F.lit(0).alias("entity"), "point_id"))
    if not fits:
        raise ValueError("no group to fit")
    table, points = fits[0], inliers[0]
    for more in fits[1:]:
        table = table.unionByName(more)
    for more in inliers[1:]:
        points = points.unionByName(more)
    return materialize(table.select(key, *_ENTITY), "fits"), materialize(points, "fit-inliers")
