"""Planes: distances, mergeable moments, least squares, robust refits and hypotheses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Vec, canonical_plane, signed_distance
from ..scratch import materialize
from .numbering import numbered
from .stats import quantile

XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class Plane:
    """n . x + d = 0 with a unit normal whose largest component is not negative."""

    normal: tuple[float, float, float]
    d: float

    @staticmethod
    def of(normal, d: float) -> "Plane":
        n = np.asarray(normal, dtype=np.float64)
        size = float(np.sqrt((n * n).sum()))
        if n.shape != (3,) or not np.isfinite(size) or size == 0:
            raise ValueError("a plane needs a finite, non-zero normal")
        k = (-1.0 if n[int(np.abs(n).argmax())] < 0 else 1.0) / size
        return Plane(tuple(float(c) for c in n * k), float(d) * k)

    @staticmethod
    def from_array(abcd) -> "Plane":
        if len(abcd) != 4:
            raise ValueError("expected four numbers a, b, c, d")
        return Plane.of(abcd[:3], abcd[3])

    def as_array(self) -> list[float]:
        return [*self.normal, self.d]

    def angle_to(self, other: "Plane") -> float:
        return float(np.arccos(min(1.0, abs(float(np.dot(self.normal, other.normal))))))

    def signed(self, p: Vec | None = None) -> Column:
        """Signed distance of the columns x, y, z, or of ``p``."""
        return signed_distance(p or Vec.cols(*XYZ), Vec.of(*self.normal), F.lit(self.d))


def moment_columns(condition: Column | None = None) -> list[Column]:
    """Count, centroid and population covariances: partial sums merge, so one shuffle of a row a group."""
    c = {n: F.col(n) if condition is None else F.when(condition, F.col(n)) for n in XYZ}
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return [F.count(c["x"]).alias("n"), *(F.avg(c[a]).alias(f"m{a}") for a in XYZ), *(F.covar_pop(c[a], c[b]).alias(f"c{a}{b}") for a, b in pairs)]


def _matrices(m: pd.DataFrame) -> np.ndarray:
    return m[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy(dtype=np.float64).reshape(-1, 3, 3)


def _canonical(v: np.ndarray) -> np.ndarray:
    k = np.abs(v).argmax(axis=1)
    return v * np.where(v[np.arange(len(v)), k] < 0, -1.0, 1.0)[:, None]


def eigen_rows(moments: DataFrame, key: str, axis: int) -> DataFrame:
    """(key, n, vx, vy, vz, d, value) of each row of moments: the axis-th eigenvector, smallest first.

    Rows of fewer than three points, or of non-finite moments, give nulls.  One row a
    group: the points themselves never leave the JVM.
    """
    kind = dict(moments.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in batches:
            a = _matrices(m)
            ok = (m["n"].to_numpy() >= 3) & np.isfinite(a).all(axis=(1, 2))
            a[~ok] = np.eye(3)
            values, vectors = np.linalg.eigh(a)
            v = _canonical(vectors[:, :, axis])
            d = -(v * m[["mx", "my", "mz"]].to_numpy(dtype=np.float64)).sum(axis=1)
            out = pd.DataFrame({key: m[key], "n": m["n"], "vx": v[:, 0], "vy": v[:, 1], "vz": v[:, 2], "d": d, "value": values[:, axis]})
            out.loc[~ok, ["vx", "vy", "vz", "d", "value"]] = None
            yield out

    return moments.mapInPandas(run, f"{key} {kind}, n long, vx double, vy double, vz double, d double, value double")


def fit_planes(cloud: DataFrame, key: str) -> DataFrame:
    """Least-squares plane of each group: (key, n, nx, ny, nz, d)."""
    fits = eigen_rows(cloud.groupBy(key).agg(*moment_columns()), key, 0)
    return fits.select(key, "n", F.col("vx").alias("nx"), F.col("vy").alias("ny"), F.col("vz").alias("nz"), "d")


def principal_axes(cloud: DataFrame, key: str) -> DataFrame:
    """Direction of largest spread of each group: (key, n, ux, uy, uz)."""
    fits = eigen_rows(cloud.groupBy(key).agg(*moment_columns()), key, 2)
    return fits.select(key, "n", F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("vz").alias("uz"))


def plane_of_moments(row) -> Plane:
    """The plane of one collected row of moments."""
    if row["n"] < 3:
        raise ValueError("a plane takes three points or more")
    m = pd.DataFrame([row.asDict()])
    a = _matrices(m)[0]
    if not np.isfinite(a).all():
        raise ValueError("the moments of the points are not finite")
    n = np.linalg.eigh(a)[1][:, 0]
    return Plane.of(n, -float(n @ m[["mx", "my", "mz"]].to_numpy()[0]))


def fit_plane(cloud: DataFrame, condition: Column | None = None) -> Plane:
    return plane_of_moments(cloud.agg(*moment_columns(condition)).first())


@dataclass(frozen=True)
class RobustFit:
    plane: Plane
    threshold: float
    converged: bool
    n_iterations: int
    n_inliers: int
    among: Column | None = None

    def inlier(self) -> Column:
        near = F.abs(self.plane.signed()) <= self.threshold
        return near if self.among is None else near & self.among


def mad_sigma(cloud: DataFrame, residual: Column) -> float | None:
    """1.4826 times the median absolute deviation, exact at any size; None where no residual is finite."""
    med = quantile(cloud, residual)
    return None if med is None else 1.4826 * quantile(cloud, F.abs(residual - med))


def robust_fit_plane(
    cloud: DataFrame, threshold: float | None = None, sigma_factor: float = 3.0, max_iterations: int = 50,
    init: Plane | None = None, min_inlier_fraction: float = 0.1, among: Column | None = None,
) -> RobustFit:
    """Refit on the points within the threshold until they stay the same.

    Each step depends on the last plane's five numbers only, so every step is one
    aggregate over the same table: inliers, how many changed, and the moments of the
    next fit come from a single scan.  A threshold that is None follows the MAD of the
    current inliers.  With ``among``, only points where it holds are fitted or
    count as inliers; where it is null it does not hold.
    """
    cloud = cloud if among is None else cloud.filter(among)
    n = cloud.count()
    if n < 3:
        raise ValueError("a plane takes three points or more")
    plane = init or fit_plane(cloud)
    mask, thr, it = F.lit(True), threshold, 0
    converged, inliers = False, n
    for it in range(1, max_iterations + 1):
        r = plane.signed()
        if threshold is None:
            sigma = mad_sigma(cloud.filter(mask), r)
            thr = sigma_factor * (sigma or 0.0)
            if not np.isfinite(thr) or thr <= 0:
                raise ValueError("the adaptive threshold collapsed: no spread of residuals")
        new = F.abs(r) <= thr
        row = cloud.agg(F.sum((new != mask).cast("long")).alias("changed"), *moment_columns(new)).first()
        inliers = row["n"]
        if inliers < max(3, int(min_inlier_fraction * n)):
            raise ValueError(f"too few inliers ({inliers}) at threshold {thr:.6g}")
        if row["changed"] == 0 and it > 1:
            converged = True
            break
        mask, plane = new, plane_of_moments(row)
    inliers = cloud.filter(F.abs(plane.signed()) <= thr).count()
    return RobustFit(plane, float(thr), converged, it, inliers, among)


def ransac_plane(cloud: DataFrame, threshold: float, n_iterations: int = 1000, seed: int = 0, pool: int = 100_000) -> tuple[Plane, int]:
    """The three-point plane with most points within the threshold, the first of equal ones.

    Hypotheses come from a hash-ordered pool of bounded size and are scored on it, on the
    driver; the number of points within the threshold of the best one is counted over the
    whole cloud.
    """
    rows = cloud.select("point_id", *XYZ).orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(pool)
    p = rows.toPandas()[list(XYZ)].to_numpy(dtype=np.float64)  # at most ``pool`` rows
    if len(p) < 3:
        raise ValueError("a plane takes three points or more")
    pick = np.random.default_rng(seed).integers(0, len(p), (n_iterations, 3))
    a, b, c = p[pick[:, 0]], p[pick[:, 1]], p[pick[:, 2]]
    normal = np.cross(b - a, c - a)
    size = np.linalg.norm(normal, axis=1)
    ok = size > 1e-12
    if not ok.any():
        raise ValueError("no plane hypothesis: all samples are degenerate")
    normal = normal[ok] / size[ok, None]
    d = -(normal * a[ok]).sum(axis=1)
    score = np.zeros(len(d), dtype=np.int64)
    for i in range(0, len(p), 8192):
        score += (np.abs(p[i : i + 8192] @ normal.T + d) <= threshold).sum(axis=0)
    best = int(score.argmax())
    plane = Plane.of(normal[best], d[best])
    return plane, cloud.filter(F.abs(plane.signed()) <= threshold).count()


#: Hypotheses of one normal that are counted by one sweep, at least; bins of a sweep; points taken at once.
_SHARED, _BINS, _CHUNK = 8, 1 << 14, 1 << 16


class _Sweep:
    """Counts of many offsets of one normal: the points' projections are binned once, whatever the number of offsets.

    A hypothesis holds the points whose projection lies from -d - threshold to -d +
    threshold.  Bins that no such edge touches count as a whole; points of the others are
    looked up among the edges, and those so near an edge that rounding could decide are
    tested as the Column form has it.
    """

    def __init__(self, normal: np.ndarray, d: np.ndarray, threshold: float):
        self.normal, self.d, self.threshold = normal, d, threshold
        self.edges = np.sort(np.concatenate([-d - threshold, -d + threshold]))
        self.first, self.last = np.searchsorted(self.edges, -d - threshold), np.searchsorted(self.edges, -d + threshold)
        self.low = self.edges[0]
        self.scale = _BINS / (self.edges[-1] - self.low)
        self.spot = np.searchsorted(self.edges, self.low + (np.arange(_BINS + 2) - 0.5) / self.scale)
        self.slack = -1.0
        self.hot = np.zeros(0, dtype=bool)

    def _bin(self, v: np.ndarray) -> np.ndarray:
        b = v - self.low
        b *= self.scale
        b += 1
        return np.clip(b, 0, _BINS + 1, out=b).astype(np.intp)

    def hits(self, x: np.ndarray, v: np.ndarray, reach: float) -> np.ndarray:
        """Points of each hypothesis among ``x``, whose projections are ``v``; no coordinate is beyond ``reach``."""
        slack = 1e-13 * (reach * np.abs(self.normal).sum() + np.abs(self.d).max() + self.threshold)
        if slack != self.slack:
            mark = np.zeros(_BINS + 3, dtype=np.int64)
            np.add.at(mark, self._bin(self.edges - 2 * slack), 1)
            np.add.at(mark, self._bin(self.edges + 2 * slack) + 1, -1)
            self.slack, self.hot = slack, np.cumsum(mark)[:-1] > 0
        b = self._bin(v)
        whole = np.where(self.hot, 0, np.bincount(b, minlength=_BINS + 2))
        n = np.bincount(self.spot, weights=whole, minlength=len(self.edges) + 1).astype(np.int64)
        at = np.flatnonzero(self.hot.take(b))
        h = v[at]
        k = np.searchsorted(self.edges, h)
        gap = np.minimum(np.abs(h - self.edges[np.maximum(k - 1, 0)]), np.abs(h - self.edges[np.minimum(k, len(self.edges) - 1)]))
        near = gap <= slack
        n += np.bincount(k[~near], minlength=len(n))
        below = np.cumsum(n)  # of each edge
        out = below[self.last] - below[self.first]
        at, q = at[near], self.normal
        step = max(1, 4_000_000 // len(self.d))
        for i in range(0, len(at), step):
            a = x[at[i : i + step]]
            exact = np.abs((a[:, 0] * q[0] + a[:, 1] * q[1] + a[:, 2] * q[2])[:, None] + self.d)
            out += (exact <= self.threshold).sum(axis=0)
        return out


def _direct(x: np.ndarray, p: np.ndarray, threshold: float) -> np.ndarray:
    """Points of each plane of ``p`` by matrix products; near the threshold as the Column form has it."""
    hits = np.zeros(len(p), dtype=np.int64)
    size = np.abs(p[:, :3]).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(p)))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        over = np.abs(part @ p[:, :3].T + p[:, 3])
        over -= threshold
        slack = 1e-13 * (np.abs(part).max() * size + np.abs(p[:, 3]) + threshold)
        hits += (over < -slack).sum(axis=0)
        row, col = np.nonzero(np.abs(over) <= slack)
        a, q = part[row], p[col]
        exact = np.abs(a[:, 0] * q[:, 0] + a[:, 1] * q[:, 1] + a[:, 2] * q[:, 2] + q[:, 3])
        np.add.at(hits, col[exact <= threshold], 1)
    return hits


def count_inliers(chunks: Iterator[np.ndarray], p: np.ndarray, threshold: float) -> np.ndarray:
    """Points within ``threshold`` of each plane (nx, ny, nz, d) of ``p``; planes of one normal share a sweep."""
    hits = np.zeros(len(p), dtype=np.int64)
    _, of, n = np.unique(p[:, :3], axis=0, return_inverse=True, return_counts=True)
    of = of.reshape(-1)
    fit = np.isfinite(p).all(axis=1) & (n[of] >= _SHARED) & (0 < threshold < float("inf"))
    alone = np.flatnonzero(~fit)
    rows = np.flatnonzero(fit)
    rows = rows[np.argsort(of[rows], kind="stable")]
    groups = np.split(rows, np.flatnonzero(np.diff(of[rows])) + 1) if len(rows) else []
    sweeps = [_Sweep(p[g[0], :3], p[g, 3], threshold) for g in groups]
    normals = np.array([s.normal for s in sweeps]).reshape(-1, 3)
    for x in chunks:
        x = x[np.isfinite(x).all(axis=1)]
        if not len(x):
            continue
        if len(alone):
            hits[alone] += _direct(x, p[alone], threshold)
        turned = np.ascontiguousarray(x.T)
        reach = 2.0 ** np.ceil(np.log2(max(np.abs(x).max(), 1e-300)))  # a power of two, so that chunks mostly share it
        for i in range(0, len(sweeps), 16):
            for g, s, v in zip(groups[i : i + 16], sweeps[i : i + 16], normals[i : i + 16] @ turned, strict=True):
                hits[g] += s.hits(x, v, reach)
    return hits


def score_hypotheses(cloud: DataFrame, planes: DataFrame, threshold: float, block: int = 20_000) -> DataFrame:
    """(hyp_id, inliers) of any number of plane hypotheses (hyp_id, nx, ny, nz, d).

    Hypotheses are numbered by their normals and go to every task in blocks, a pass over
    the cloud each.  Those of one normal are counted together, from one projection of each
    point; the others meet batches of points in matrix products.  A distance so near the
    threshold that rounding could decide is computed again as the Column form has it.  A
    task sends one count a hypothesis.
    """
    listed = numbered(planes.select("hyp_id", "nx", "ny", "nz", "d"), ["nx", "ny", "nz", "d", "hyp_id"], "place")
    listed = materialize(listed.withColumn("block", F.floor(F.col("place") / block)), "hypotheses")
    blocks = (listed.agg(F.max("block")).first()[0] or 0) + 1
    out = None
    for k in range(blocks):
        rows = listed.filter(F.col("block") == k).select("hyp_id", "nx", "ny", "nz", "d").collect()  # at most ``block``
        table = np.array([[r["nx"], r["ny"], r["nz"], r["d"]] for r in rows], dtype=np.float64).reshape(-1, 4)
        held = cloud.sparkSession.sparkContext.broadcast((np.array([r["hyp_id"] for r in rows], dtype=np.int64), table))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, p = held.value

            def chunks() -> Iterator[np.ndarray]:
                got, n = [], 0
                for pdf in batches:
                    got.append(pdf[list(XYZ)].to_numpy(dtype=np.float64))
                    n += len(pdf)
                    if n >= _CHUNK:
                        yield np.concatenate(got)
                        got, n = [], 0
                if got:
                    yield np.concatenate(got)

            yield pd.DataFrame({"hyp_id": ids, "inliers": count_inliers(chunks(), p, threshold)})

        own = cloud.select(*XYZ).mapInPandas(run, "hyp_id long, inliers long").groupBy("hyp_id").agg(F.sum("inliers").alias("inliers"))
        out = own if out is None else out.unionByName(own)
    return out


def peel(cloud: DataFrame, members: DataFrame) -> DataFrame:
    """The points that are not members."""
    return cloud.join(members.select("point_id"), "point_id", "left_anti")


__all__ = ["Plane", "RobustFit", "canonical_plane", "fit_plane", "fit_planes", "mad_sigma", "peel", "principal_axes", "ransac_plane", "robust_fit_plane", "score_hypotheses"]
