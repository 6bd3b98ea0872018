"""Rigid frames, unrolled cylinders and circle residuals as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import Vec, inplane_basis


def frame_apply(p: Vec, rotation: list[list[float]], origin: tuple[float, float, float]) -> Vec:
    """x' = R (x - o)."""
    q = p - Vec.of(*origin)
    return Vec(*(q.dot(Vec.of(*row)) for row in rotation))


def frame_inverse(p: Vec, rotation: list[list[float]], origin: tuple[float, float, float]) -> Vec:
    """x = R' x' + o."""
    return Vec(*(p.dot(Vec.of(*column)) for column in zip(*rotation, strict=True))) + Vec.of(*origin)


def circle_residual(p: Vec, center: Vec, normal: Vec, diameter: float) -> Column:
    """In-plane radius less half the diameter; the distance from the plane does not count."""
    u, v = inplane_basis(normal)
    w = p - center
    return F.hypot(w.dot(u), w.dot(v)) - diameter / 2


def unrolled(p: Vec, point: Vec, direction: Vec, radius: float) -> tuple[Column, Column, Column]:
    """(s, z, residual) on a cylinder: arc length, height along the axis, axis distance less radius."""
    a, b = inplane_basis(direction)
    w = p - point
    x, y = w.dot(a), w.dot(b)
    return F.lit(float(radius)) * F.atan2(y, x), w.dot(direction), F.hypot(x, y) - radius
