"""What is done with a selected rectangle of a face: its map on given edges, its histogram, a refit, a circle."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Vec
from .extract import MainPlane, MainPlaneParams, extract_main_plane
from .maps import FaceFrame, ResidualMap, residual_uv_map
from .planes import Plane
from .regions import rectangle
from .rounds import RoundParams, fit_circles
from .stats import bimodality


def edge_bin(value: Column, edges: list[float]) -> Column:
    """The place of ``value`` among sorted edges, from 0; the last bin is closed, null outside and for null.

    A tree of comparisons with literals, as deep as the logarithm of their number, so that
    the search stays in generated code.
    """
    edges = [float(e) for e in edges]
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must be two or more increasing numbers")

    def search(first: int, last: int) -> Column:
        """The bin among first ... last."""
        if first == last:
            return F.lit(first)
        mid = (first + last + 1) // 2
        return F.when(value < edges[mid], search(first, mid - 1)).otherwise(search(mid, last))

    return F.when((value >= edges[0]) & (value <= edges[-1]), search(0, len(edges) - 2)).cast("long")


def map_on_edges(frame: DataFrame, u: Column, v: Column, value: Column, u_edges: list[float], v_edges: list[float]) -> DataFrame:
    """(iu, iv, cnt, mean) on the cells between given edges; points outside and cells without points are absent."""
    cells = frame.select(edge_bin(u, u_edges).alias("iu"), edge_bin(v, v_edges).alias("iv"), value.alias("r")).dropna(subset=["iu", "iv"])
    return cells.groupBy("iu", "iv").agg(F.count("*").alias("cnt"), F.avg("r").alias("mean"))


def map_edges(of: ResidualMap, bins: int) -> tuple[list[float], list[float]]:
    """The (u, v) edges of a map's cells."""
    return tuple(np.linspace(of.low[i], of.high[i], bins + 1).tolist() for i in (0, 1))


def select(cloud: DataFrame, frame: FaceFrame, u_range: tuple[float, float], v_range: tuple[float, float]) -> DataFrame:
    """Points whose places in a face's frame are in a rectangle, its border included."""
    u, v, _ = frame.coords()
    return rectangle(cloud, u, v, u_range, v_range)


def selection_map(selected: DataFrame, base: ResidualMap, plane: Plane, bins: int) -> DataFrame:
    """The selected points' residual map on the cells of the base map."""
    u, v, _ = base.frame.coords()
    return map_on_edges(selected, u, v, plane.signed(), *map_edges(base, bins))


@dataclass
class Refit:
    """A plane of a selection as the next entry of a group's fit."""

    plane_index: int
    source_plane_index: int
    n_selected: int
    face: MainPlane
    bimodal: bool
    map: ResidualMap | None


def next_index(entries: list[dict], key: str) -> int:
    """One more than the largest index, whichever are missing; 0 for none."""
    return max((int(e.get(key, 0)) for e in entries), default=-1) + 1


def refit_selection(
    selected: DataFrame, plane: Plane, frame: FaceFrame, entries: list[dict], source_index: int = 0, params: MainPlaneParams = MainPlaneParams(max_threshold_mm=0.5), bins: int | None = None,
) -> Refit:
    """A face of the selected points, started from the face they were selected on.

    It needs 50 points, and a fifth of the selection (at most 1,000) in its main component.
    Its map, if ``bins`` is given, keeps the axes of the source face.
    """
    n = selected.count()
    if n < 50:
        raise ValueError(f"too few points in the selection ({n}; 50 are needed)")
    face = extract_main_plane(selected, replace(params, min_points=min(1000, max(50, n // 5))), None, plane)
    if face.n_points < 50:
        raise ValueError("the refit's main component has too few points")
    face.reasons = [*face.reasons, "selection_refit"]
    two = bool(face.mad_sigma) and bool(bimodality(face.members, face.plane.signed(), face.mad_sigma).first()["bimodal"])
    shown = residual_uv_map(face.members, face.plane, bins, frame) if bins else None
    return Refit(next_index(entries, "plane_index"), source_index, n, face, two, shown)


def circle_on_selection(selected: DataFrame, plane: Plane, entries: list[dict], diameter_mm: float | None = None, params: RoundParams = RoundParams(threshold_mm=0.5, ransac_iterations=800)) -> dict:
    """A circle of the selected points in the locked plane of their face, as the next circle of the group's fit; 20 points are needed."""
    n = selected.count()
    if n < 20:
        raise ValueError(f"too few points in the selection ({n}; 20 are needed)")
    fixed = [F.lit(float(c)).alias(k) for k, c in zip(("nx", "ny", "nz", "d"), plane.as_array(), strict=True)]
    rows = selected.select(F.lit(0).alias("one"), "point_id", "x", "y", "z", *fixed)
    r = fit_circles(rows, "one", replace(params, diameter_mm=diameter_mm)).first().asDict()
    return {
        "circle_index": next_index(entries, "circle_index"), "center": [r["px"], r["py"], r["pz"]], "normal": list(plane.normal), "diameter_mm": r["diameter_mm"], "diameter_fixed": diameter_mm is not None,
        "n_points": r["n_inliers"], "status": r["status"], "mad_sigma_mm": r["mad_sigma_mm"], "threshold_mm": r["threshold_mm"], "n_selected": n,
    }


def axis_extent(cloud: DataFrame, point, direction) -> tuple[float, float]:
    """First and last place of the points along a cylinder's axis, from its point; +-50 where they are less than 1 mm apart."""
    t = (Vec.cols("x", "y", "z") - Vec.of(*point)).dot(Vec.of(*direction))
    low, high = cloud.agg(F.min(t), F.max(t)).first()
    return (-50.0, 50.0) if low is None or high - low < 1.0 else (low, high)


__all__ = ["Refit", "axis_extent", "circle_on_selection", "edge_bin", "map_edges", "map_on_edges", "next_index", "refit_selection", "select", "selection_map"]
