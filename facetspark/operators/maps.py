"""Residual maps of faces in a frame along the sides of their smallest bounding rectangle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Vec
from .planes import Plane
from .stats import mean_map

@dataclass(frozen=True)
class FaceFrame:
    """Right-handed unit axes u, v and n at a center."""

    center: tuple[float, float, float]
    u: tuple[float, float, float]
    v: tuple[float, float, float]
    n: tuple[float, float, float]

    def coords(self) -> tuple[Column, Column, Column]:
        """(u, v, n) of the columns x, y, z."""
        p = Vec.cols("x", "y", "z") - Vec.of(*self.center)
        return p.dot(Vec.of(*self.u)), p.dot(Vec.of(*self.v)), p.dot(Vec.of(*self.n))


def start_axes(normal) -> tuple[np.ndarray, np.ndarray]:
    """The same (u, v) across a unit normal as ``functions.columns.inplane_basis``, as numbers."""
    n = np.asarray(normal, dtype=np.float64)
    u = np.cross(n, (0.0, 1.0, 0.0) if abs(n[0]) > 0.9 else (1.0, 0.0, 0.0))
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (n, 2) points, in turning order; a line gives its two ends.

    A chord between two corners is cut at the point farthest beyond it until no point
    is beyond: whole-array steps, and only points still outside are looked at again.
    """
    p = np.asarray(points, dtype=np.float64)
    if not len(p):
        return p.reshape(0, 2)
    left, right = p[p[:, 0] == p[:, 0].min()], p[p[:, 0] == p[:, 0].max()]
    first, last = left[left[:, 1].argmin()], right[right[:, 1].argmax()]
    if (first == last).all():
        return first[None]
    done: list[np.ndarray] = []
    chords = [(last, first, p), (first, last, p)]
    while chords:
        a, b, q = chords.pop()
        beyond = (b[0] - a[0]) * (q[:, 1] - a[1]) - (b[1] - a[1]) * (q[:, 0] - a[0])
        out = beyond > 0
        if not out.any():
            done.append(a)
            continue
        q = q[out]
        top = q[beyond[out].argmax()]
        chords += [(top, b, q), (a, top, q)]
    return np.array(done)


def rectangle_side(hull: np.ndarray) -> np.ndarray:
    """Unit direction of the longer side of the smallest rectangle around hull corners; (1, 0) if there is none.

    One side of the smallest rectangle lies along an edge; the first edge of equal areas counts.
    """
    edges = np.roll(hull, -1, axis=0) - hull
    size = np.hypot(edges[:, 0], edges[:, 1])
    edges = edges[size > 1e-12] / size[size > 1e-12, None]
    best, side = np.inf, np.array([1.0, 0.0])
    step = max(1, 2_000_000 // max(1, len(hull)))
    for i in range(0, len(edges), step):
        e = edges[i : i + step]
        along, across = np.ptp(e @ hull.T, axis=1), np.ptp(np.column_stack([-e[:, 1], e[:, 0]]) @ hull.T, axis=1)
        k = int((along * across).argmin())
        if along[k] * across[k] < best:
            best = along[k] * across[k]
            side = e[k] if along[k] >= across[k] else np.array([-e[k, 1], e[k, 0]])
    return side


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hull of a task's points; a hull of hulls is the hull of all."""
    kept = np.empty((0, 2))
    for b in batches:
        kept = corners(np.vstack([kept, np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()])]))
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kept[:, i]), pa.float64()) for i in (0, 1)], names=["a", "b"])


def hull(flat: DataFrame) -> np.ndarray:
    """Corners of the convex hull of all points (a, b), exactly.

    Tasks send the hulls of their points, which one task and the driver join: both hold
    corners only, whose number grows with the outline and not with the points.
    """
    ends = flat.mapInArrow(_hulls, "a double, b double").repartition(1).mapInArrow(_hulls, "a double, b double").toPandas()
    return corners(ends.to_numpy(dtype=np.float64).reshape(-1, 2))


def _finite(cloud: DataFrame) -> DataFrame:
    """Without points that have a null or non-finite coordinate."""
    return cloud.filter(F.abs("x") + F.abs("y") + F.abs("z") < float("inf"))


def aligned_frame(cloud: DataFrame, plane: Plane) -> FaceFrame | None:
    """The frame of a face: u along the longer side of its smallest rectangle, at the centroid; None without points.

    u points to where the face reaches farther from its centroid, and v = n x u.  Fewer
    than three points, or all in one place, keep the axes that the normal alone gives.
    """
    cloud, n = _finite(cloud), np.asarray(plane.normal)
    u, v = start_axes(n)
    p = Vec.cols("x", "y", "z")
    a, b = p.dot(Vec.of(*u)), p.dot(Vec.of(*v))
    mid = cloud.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"]).first()
    if not mid["n"]:
        return None
    center = (mid["x"], mid["y"], mid["z"])
    if mid["n"] >= 3:
        ends = hull(cloud.select(a.alias("a"), b.alias("b"))) - [np.dot(center, u), np.dot(center, v)]
        side = rectangle_side(ends)
        reach = ends @ side
        if -reach.min() > reach.max():
            side = -side
        u = side[0] * u + side[1] * v
        u /= np.linalg.norm(u)
        v = np.cross(n, u)
    return FaceFrame(center, tuple(u.tolist()), tuple(v.tolist()), plane.normal)


def locked_frame(source: FaceFrame, plane: Plane, center: tuple[float, float, float] | None = None) -> FaceFrame:
    """The source's axes turned onto another plane: u is projected, and the pair nearer to the source's of the two senses is kept."""
    n, u = np.asarray(plane.normal), np.asarray(source.u)
    u = u - (u @ n) * n
    size = np.linalg.norm(u)
    if size < 1e-12:
        u, v = start_axes(n)
    else:
        u = u / size
        v = np.cross(n, u)
        if u @ np.asarray(source.u) + v @ np.asarray(source.v) < 0:
            u, v = -u, -v
    return FaceFrame(center or source.center, tuple(u.tolist()), tuple(v.tolist()), plane.normal)


@dataclass(frozen=True)
class ResidualMap:
    """Cells (iu, iv, cnt, mean), points (point_id, u, v, r), the frame and the lowest and highest (u, v, n)."""

    cells: DataFrame
    points: DataFrame
    frame: FaceFrame
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    n_used: int


def residual_uv_map(cloud: DataFrame, plane: Plane, bins: int = 200, frame: FaceFrame | None = None) -> ResidualMap | None:
    """Mean signed residual and count on bins x bins cells of the face's own rectangle, or of a given frame.

    ``frame`` keeps another map's axes and center, turned onto this plane.  Points with a
    null or non-finite coordinate take no part; None if no point is left.
    """
    cloud = _finite(cloud)
    at = locked_frame(frame, plane) if frame else aligned_frame(cloud, plane)
    if at is None:
        return None
    u, v, w = at.coords()
    row = cloud.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate((u, v, w)) for k, f in (("a", F.min), ("b", F.max))]).first()
    if not row["n"]:
        return None
    low, high = (tuple(row[f"{k}{i}"] for i in range(3)) for k in "ab")
    r = plane.signed()
    return ResidualMap(
        mean_map(cloud, u, v, r, (low[0], high[0], low[1], high[1]), bins), cloud.select("point_id", u.alias("u"), v.alias("v"), r.alias("r")), at, low, high, row["n"]
    )
