"""Robust circles and cylinders, a fit a group: mergeable sums where they do, pandas a group where they iterate."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .quantiles import group_quantiles


@dataclass(frozen=True)
class RoundParams:
    threshold_mm: float | None = None
    boot_threshold_mm: float = 3.0
    sigma_factor: float = 3.0
    ransac_iterations: int = 800
    max_iterations: int = 30
    min_inlier_fraction: float = 0.1
    diameter_mm: float | None = None
    seed: int = 0
    #: A group beyond this takes its hypotheses from a sample by hash; all else reads all its points.
    max_points: int = 80_000


def basis(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([0.0, 1.0, 0.0]) if abs(n[0]) > 0.9 else np.array([1.0, 0.0, 0.0])
    u = np.cross(n, a)
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def circle_lsq(q: np.ndarray, radius: float | None = None) -> tuple[np.ndarray, float]:
    """Center and radius in the plane; with a fixed radius the center moves by the mean radial error."""
    if radius is not None:
        c = q.mean(axis=0)
        for _ in range(20):
            w = q - c
            rho = np.maximum(np.linalg.norm(w, axis=1), 1e-12)
            c = c + (((rho - radius) / rho)[:, None] * w).mean(axis=0)
        return c, radius
    m = q.mean(axis=0)
    w = q - m
    s = (w * w).sum(axis=1)
    c, *_ = np.linalg.lstsq(2 * (w.T @ w), w.T @ (s - s.mean()), rcond=None)
    return c + m, float(np.sqrt(max(0.0, s.mean() + c @ c)))


def three_point_circles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(valid, centers, unit normals, radii) through rows of points."""
    u, v = b - a, c - a
    n = np.cross(u, v)
    size = (n * n).sum(axis=1)
    ok = size > 1e-18
    safe = np.where(ok, size, 1.0)[:, None]
    rel = (np.cross(n, u) * (v * v).sum(axis=1)[:, None] + np.cross(v, n) * (u * u).sum(axis=1)[:, None]) / (2 * safe)
    return ok, a + rel, n / np.sqrt(safe), np.linalg.norm(rel, axis=1)


#: A fit asks for sums or the median of a function of its points, and goes on with the answer.
Steps = Generator[tuple[str, Callable[[np.ndarray], np.ndarray]], np.ndarray, dict]


def _mad(values: Callable[[np.ndarray], np.ndarray]):
    mid = float((yield "median", values))
    return 1.4826 * float((yield "median", lambda y: np.abs(values(y) - mid)))


def _axis_residual(x: np.ndarray, point: np.ndarray, u: np.ndarray, radius: float) -> np.ndarray:
    w = x - point
    t = w @ u
    return np.sqrt(np.maximum((w * w).sum(axis=1) - t * t, 0.0)) - radius


def refine_geometric(inside: Callable[[np.ndarray], np.ndarray], point: np.ndarray, u: np.ndarray, radius: float, fixed: bool, steps: int = 25):
    """Levenberg-Marquardt on the axis distances: two shifts, two tilts and, unless fixed, the radius."""

    def at(point: np.ndarray, u: np.ndarray, radius: float) -> Callable[[np.ndarray], np.ndarray]:
        a, b = basis(u)

        def sums(y: np.ndarray) -> np.ndarray:
            y = y[inside(y)]
            r = _axis_residual(y, point, u, radius)
            w = y - point
            t = w @ u
            across = w - t[:, None] * u
            e = across / np.maximum(np.linalg.norm(across, axis=1), 1e-12)[:, None]
            jac = np.stack([-(e @ a), -(e @ b), -(e @ a) * t, -(e @ b) * t] + ([] if fixed else [-np.ones(len(y))]), axis=1)
            return np.concatenate([[r @ r], jac.T @ r, (jac.T @ jac).reshape(-1)])

        return sums

    k = 4 if fixed else 5
    damp = 1e-3
    got = yield "sum", at(point, u, radius)
    for _ in range(steps):
        cost, g, h = float(got[0]), got[1 : k + 1], got[k + 1 :].reshape(k, k)
        a, b = basis(u)
        try:
            d = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), -g)
        except np.linalg.LinAlgError:
            break
        tilt = np.clip(d[2:4], -0.4, 0.4)
        nu = u + tilt[0] * a + tilt[1] * b
        nu /= np.linalg.norm(nu)
        np_ = point + d[0] * a + d[1] * b
        nr = radius if fixed else radius + d[4]
        new = yield "sum", at(np_, nu, nr)
        if float(new[0]) < cost:
            point, u, radius, got, damp = np_, nu, nr, new, damp * 0.4
            if cost - float(new[0]) < 1e-14 * max(float(new[0]), 1.0):
                break
        else:
            damp *= 2.5
            if damp > 1e12:
                break
    return point, u, radius


def _circle(flat: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, n: float, radius: float | None):
    """``circle_lsq`` by sums over the n rows that ``flat`` gives, of this mean."""
    if radius is not None:
        c = mean
        for _ in range(20):

            def error(y: np.ndarray, c: np.ndarray = c) -> np.ndarray:
                w = flat(y) - c
                rho = np.maximum(np.linalg.norm(w, axis=1), 1e-12)
                return (((rho - radius) / rho)[:, None] * w).sum(axis=0)

            c = c + (yield "sum", error) / n
        return c, radius

    def sums(y: np.ndarray) -> np.ndarray:
        w = flat(y) - mean
        s = (w * w).sum(axis=1)
        return np.concatenate([(w.T @ w).reshape(-1), w.T @ s, w.sum(axis=0), [s.sum()]])

    got = yield "sum", sums
    s = got[8] / n
    c, *_ = np.linalg.lstsq(2 * got[:4].reshape(2, 2), got[4:6] - s * got[6:8], rcond=None)
    return c + mean, float(np.sqrt(max(0.0, s + c @ c)))


def cylinder_start(x: np.ndarray, p: RoundParams, axis: np.ndarray | None = None) -> list[float]:
    """Origin, point, direction and radius of the best hypothesis: of three points, or around the main or given axis."""
    o = x.mean(axis=0)
    x = x - o
    rng = np.random.default_rng(p.seed)
    fixed = p.diameter_mm is not None
    boot = p.threshold_mm or p.boot_threshold_mm
    u = np.linalg.eigh(np.cov(x.T))[1][:, 2] if axis is None else axis / np.linalg.norm(axis)
    best, score = None, -1
    pick = rng.integers(0, len(x), (p.ransac_iterations, 3))
    ok, centers, normals, radii = three_point_circles(*(x[pick[:, i]] for i in range(3)))
    if axis is None:
        for i in np.flatnonzero(ok & (radii > 0)):
            if fixed and abs(2 * radii[i] - p.diameter_mm) > 2 * boot:
                continue
            n = int((np.abs(_axis_residual(x, centers[i], normals[i], p.diameter_mm / 2 if fixed else radii[i])) <= boot).sum())
            if n > score:
                best, score = (centers[i], normals[i], p.diameter_mm / 2 if fixed else float(radii[i])), n
    a, b = basis(u)
    c, radius = circle_lsq(np.stack([x @ a, x @ b], axis=1), p.diameter_mm / 2 if fixed else None)
    point = c[0] * a + c[1] * b + (x @ u).mean() * u
    if axis is not None or int((np.abs(_axis_residual(x, point, u, radius)) <= boot).sum()) > score:
        best = point, u, radius
    return [*o, *best[0], *best[1], best[2]]


def cylinder_steps(start: list[float], count: int, p: RoundParams, axis: np.ndarray | None = None) -> Steps:
    """Geometric refits of the inliers, on sums over all ``count`` points; with a given axis, circles around it."""
    o, point, u, radius = np.array(start[:3]), np.array(start[3:6]), np.array(start[6:9]), start[9]
    fixed = p.diameter_mm is not None
    a, b = basis(u)

    def inside(model: tuple) -> Callable[[np.ndarray], np.ndarray]:
        return lambda y: np.abs(_axis_residual(y, *model[:3])) <= model[3]

    def moved(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        return lambda y: f(y - o)

    def ask(gen):
        """The same questions, about the points less the origin."""
        try:
            kind, f = next(gen)
            while True:
                kind, f = gen.send((yield kind, moved(f)))
        except StopIteration as e:
            return e.value

    def fit():
        nonlocal point, u, radius
        model = point, u, radius, p.threshold_mm or p.boot_threshold_mm
        old, thr, converged = None, p.threshold_mm, False

        def change(y: np.ndarray) -> np.ndarray:
            now = inside(model)(y)
            return np.array([now.sum(), (now != inside(old)(y)).sum() if old else len(y), *y[now].sum(axis=0)], dtype=np.float64)

        got = yield "sum", change
        for _ in range(p.max_iterations):
            if got[0] < 6:
                return {"status": "too_few_inliers"}
            old = model
            mask = inside(old)
            if axis is None:
                point, u, radius = yield from refine_geometric(mask, point, u, radius, fixed)
            else:
                mean = got[2:] / got[0]
                c, radius = yield from _circle(lambda y, mask=mask: y[mask(y)] @ np.stack([a, b], axis=1), np.array([mean @ a, mean @ b]), got[0], radius if fixed else None)
                point = c[0] * a + c[1] * b + (mean @ u) * u
            at = point, u, radius
            if thr is None:  # from the first refit only
                thr = max(p.sigma_factor * (yield from _mad(lambda y, mask=mask, at=at: _axis_residual(y[mask(y)], *at))), 1e-6)
            model = *at, thr
            got = yield "sum", change
            if got[1] == 0:
                converged = True
                break
        if got[0] < max(6, p.min_inlier_fraction * count):
            return {"status": "low_inlier_fraction"}
        sigma = yield from _mad(lambda y: _axis_residual(y[inside(model)(y)], *model[:3]))
        sign = -1.0 if u[np.abs(u).argmax()] < 0 else 1.0
        return {"status": "ok" if converged else "not_converged", "point": point + o, "direction": sign * u, "diameter_mm": 2 * radius, "threshold_mm": thr, "n_inliers": int(got[0]), "mad_sigma_mm": sigma}

    return (yield from ask(fit()))


def circle_start(x: np.ndarray, normal: np.ndarray, d: float, p: RoundParams) -> list[float]:
    """Origin, center in the plane, radius and the plane, of the best three-point hypothesis."""
    o = x.mean(axis=0)
    u, v = basis(normal)
    q = np.stack([(x - o) @ u, (x - o) @ v], axis=1)
    off = np.abs(x @ normal + d)
    fixed = p.diameter_mm / 2 if p.diameter_mm is not None else None
    boot = p.threshold_mm or p.boot_threshold_mm
    rng = np.random.default_rng(p.seed)
    pick = rng.integers(0, len(x), (p.ransac_iterations, 3))
    ok, centers, normals, radii = three_point_circles(*(x[pick[:, i]] - o for i in range(3)))
    ok &= np.abs(normals @ normal) >= 0.85
    best, score = circle_lsq(q, fixed), -1
    for i in np.flatnonzero(ok):
        if fixed is not None and abs(radii[i] - fixed) > 2 * boot:
            continue
        c, r = np.array([centers[i] @ u, centers[i] @ v]), fixed if fixed is not None else float(radii[i])
        n = int(((np.abs(np.linalg.norm(q - c, axis=1) - r) <= boot) & (off <= boot)).sum())
        if n > score:
            best, score = (c, r), n
    return [*o, *best[0], best[1], *normal, d]


def circle_steps(start: list[float], p: RoundParams) -> Steps:
    """Refits of the inliers, near the circle and near the plane, on sums over all points."""
    o, c, radius, normal, d = np.array(start[:3]), np.array(start[3:5]), start[5], np.array(start[6:9]), start[9]
    u, v = basis(normal)
    fixed = p.diameter_mm / 2 if p.diameter_mm is not None else None

    def flat(y: np.ndarray) -> np.ndarray:
        return (y - o) @ np.stack([u, v], axis=1)

    def residual(y: np.ndarray, c: np.ndarray, radius: float) -> np.ndarray:
        return np.linalg.norm(flat(y) - c, axis=1) - radius

    def inside(model: tuple) -> Callable[[np.ndarray], np.ndarray]:
        return lambda y: (np.abs(residual(y, *model[:2])) <= model[2]) & (np.abs(y @ normal + d) <= model[2])

    model = c, radius, p.threshold_mm or p.boot_threshold_mm
    old, thr, converged = None, p.threshold_mm, False

    def change(y: np.ndarray) -> np.ndarray:
        now = inside(model)(y)
        return np.array([now.sum(), (now != inside(old)(y)).sum() if old else len(y), *flat(y[now]).sum(axis=0)], dtype=np.float64)

    got = yield "sum", change
    for _ in range(p.max_iterations):
        if got[0] < 3:
            return {"status": "too_few_inliers"}
        old = model
        mask = inside(old)
        c, radius = yield from _circle(lambda y, mask=mask: flat(y[mask(y)]), got[2:] / got[0], got[0], fixed)
        if thr is None:
            thr = max(p.sigma_factor * (yield from _mad(lambda y, mask=mask, c=c, radius=radius: residual(y[mask(y)], c, radius))), 1e-6)
        model = c, radius, thr
        got = yield "sum", change
        if got[1] == 0:
            converged = True
            break
    sigma = (yield from _mad(lambda y: residual(y[inside(model)(y)], *model[:2]))) if got[0] else float("nan")
    on = c[0] * u + c[1] * v + o
    return {"status": "ok" if converged else "not_converged", "point": on - (on @ normal + d) * normal, "direction": normal, "diameter_mm": 2 * radius, "threshold_mm": thr, "n_inliers": int(got[0]), "mad_sigma_mm": sigma}


def _run(steps: Steps, x: np.ndarray) -> dict:
    """A fit whose points are all here."""
    try:
        kind, f = next(steps)
        while True:
            v = f(x)
            kind, f = steps.send(v if kind == "sum" else np.median(v))
    except StopIteration as e:
        return e.value


def fit_cylinder(x: np.ndarray, p: RoundParams, axis: np.ndarray | None = None) -> dict:
    """One robust cylinder: three-point hypotheses, then geometric refits of the inliers."""
    return _run(cylinder_steps(cylinder_start(x, p, axis), len(x), p, axis), x) if len(x) >= 6 else {"status": "too_few_points"}


def fit_circle(x: np.ndarray, normal: np.ndarray, d: float, p: RoundParams) -> dict:
    """One robust circle in a locked plane: inliers are near the circle and near the plane."""
    return _run(circle_steps(circle_start(x, normal, d, p), p), x) if len(x) >= 3 else {"status": "too_few_points"}


_OUT = "status string, px double, py double, pz double, ux double, uy double, uz double, diameter_mm double, threshold_mm double, n_inliers long, mad_sigma_mm double"


def _answers(cloud: DataFrame, key: str, asked: dict) -> dict:
    """What the fits ask of their groups: one scan for all sums, added up by task, and one for the values of all medians."""
    kind, out = dict(cloud.dtypes)[key], {}

    def rows(of: dict, sums: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {}
            for pdf in batches:
                for g, part in pdf.groupby(key):
                    if g in of:
                        v = of[g](part[["x", "y", "z"]].to_numpy(dtype=np.float64))
                        if sums:
                            total[g] = total.get(g, 0) + v
                        else:
                            yield pd.DataFrame({key: [g] * len(v), "i": 0, "v": v})
            for g, v in total.items():
                yield pd.DataFrame({key: [g] * len(v), "i": range(len(v)), "v": v})

        return cloud.mapInPandas(run, f"{key} {kind}, i int, v double")

    sums = {g: f for g, (what, f) in asked.items() if what == "sum"}
    mids = {g: f for g, (what, f) in asked.items() if what == "median"}
    if sums:
        for r in rows(sums, True).groupBy(key, "i").agg(F.sum("v").alias("v")).orderBy(key, "i").collect():
            out.setdefault(r[key], []).append(r["v"])
        out = {g: np.array(v) for g, v in out.items()}
    if mids:
        values = materialize(rows(mids, False).select(key, "v"), "round-values")
        out |= {r[key]: r["mid"] for r in group_quantiles(values, [key], {"mid": (F.col("v"), 0.5)}).collect()}
    return out


def _per_group(cloud: DataFrame, key: str, p: RoundParams, work: Callable[[np.ndarray, pd.DataFrame], dict], start: Callable, steps: Callable, extra: list[str] = ()) -> DataFrame:
    """A fit a group: one task each up to ``max_points``; larger ones step together, each step one scan of all their points."""
    sizes = materialize(cloud.groupBy(key).agg(F.count("*").alias("__n")), "round-sizes")
    large = F.col("__n") > p.max_points
    schema = f"{key} {dict(cloud.dtypes)[key]}, {_OUT}"
    columns = [key, "point_id", "x", "y", "z", *extra]

    def record(g, r: dict) -> list:
        point, u = r.get("point", [None] * 3), r.get("direction", [None] * 3)
        return [g, r["status"], *point, *u, *(r.get(k) for k in ("diameter_mm", "threshold_mm", "n_inliers", "mad_sigma_mm"))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        return pd.DataFrame([record(pdf[key].iloc[0], work(pdf[["x", "y", "z"]].to_numpy(dtype=np.float64), pdf))], columns=[key, *[c.split()[0] for c in _OUT.split(", ")]])

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        return pd.DataFrame({key: pdf[key].iloc[:1], "at": [[float(v) for v in start(pdf[["x", "y", "z"]].to_numpy(dtype=np.float64), pdf)] if len(pdf) >= 6 else None]})

    n = {r[key]: r["__n"] for r in sizes.filter(large).filter(F.col(key).isNotNull()).collect()}
    small = cloud.join(sizes.filter(~large), key) if n else cloud.filter(F.col(key).isNotNull())
    out = small.select(columns).groupBy(key).applyInPandas(run, schema)
    if not n:
        return out
    # In order of the group, so that a batch of a later scan mostly has points of one.
    points = materialize(cloud.join(sizes.filter(large), key).select(*columns, "__n").sortWithinPartitions(key), "round-points")
    share = F.xxhash64("point_id", F.lit(p.seed))
    sample = points.filter(F.pmod(share, F.ceil(F.col("__n") / p.max_points)) == 0).groupBy(key)
    starts = {r[key]: r["at"] for r in sample.applyInPandas(begin, f"{key} {dict(cloud.dtypes)[key]}, at array<double>").collect()}
    fits = {g: steps(at, n[g]) for g, at in starts.items() if at}
    done = {g: {"status": "too_few_points"} for g in n if g not in fits}
    got = dict.fromkeys(fits)
    while got:
        asked = {}
        for g, answer in got.items():
            try:
                asked[g] = fits[g].send(answer)
            except StopIteration as e:
                done[g] = e.value
        got = _answers(points.select(key, "x", "y", "z"), key, asked) if asked else {}
    rows = [[v.item() if isinstance(v, np.generic) else v for v in record(g, r)] for g, r in done.items()]
    return out.unionByName(cloud.sparkSession.createDataFrame(rows, schema))


def fit_cylinders(cloud: DataFrame, key: str, params: RoundParams = RoundParams(), axis=None) -> DataFrame:
    """A robust cylinder of each group; a given axis direction is kept."""
    u = None if axis is None else np.asarray(axis, dtype=np.float64)
    return _per_group(
        cloud, key, params, lambda x, _: fit_cylinder(x, params, u),
        lambda x, _: cylinder_start(x, params, u), lambda at, n: cylinder_steps(at, n, params, u),
    )


def fit_circles(cloud: DataFrame, key: str, params: RoundParams = RoundParams()) -> DataFrame:
    """A robust circle of each group in the plane of the group's columns nx, ny, nz, d."""

    def plane(g: pd.DataFrame) -> tuple[np.ndarray, float]:
        return g[["nx", "ny", "nz"]].iloc[0].to_numpy(dtype=np.float64), float(g["d"].iloc[0])

    return _per_group(
        cloud, key, params, lambda x, g: fit_circle(x, *plane(g), params),
        lambda x, g: circle_start(x, *plane(g), params), lambda at, n: circle_steps(at, params), ["nx", "ny", "nz", "d"],
    )
