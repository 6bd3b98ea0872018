"""The recipe algebra on Columns: each construct and measure is one projection over any number of rows.

Planes are (Vec, Column): a unit normal of canonical sign and its offset.  Lines are
(Vec, Vec): a point and a unit direction of canonical sign.  Where the geometry has no
answer the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import Vec, canonical_plane, canonical_sign

P = tuple[Vec, Column]
L = tuple[Vec, Vec]
_TINY = 1e-12


def _only(ok: Column, v: Vec) -> Vec:
    return Vec(*(F.when(ok, c) for c in (v.x, v.y, v.z)))


def canonical_line(point: Vec, direction: Vec) -> L:
    size = direction.norm()
    return point, _only(size > 0, direction.scaled(canonical_sign(direction) / size))


def offset(a: P, distance) -> P:
    return a[0], a[1] - distance


def intersect_planes(a: P, b: P) -> L:
    """The point of the line is the one closest to the origin."""
    (n1, d1), (n2, d2) = a, b
    t = n1.cross(n2)
    size = t.norm2()
    point = (t.cross(n2).scaled(d1) - t.cross(n1).scaled(d2)).over(size)
    return canonical_line(_only(size >= _TINY, point), _only(size >= _TINY, t))


def intersect_three_planes(a: P, b: P, c: P) -> Vec:
    (n1, d1), (n2, d2), (n3, d3) = a, b, c
    det = n1.dot(n2.cross(n3))
    point = n2.cross(n3).scaled(-d1) + n3.cross(n1).scaled(-d2) + n1.cross(n2).scaled(-d3)
    return _only(det != 0, point.over(det))


def intersect_line_plane(line: L, plane: P) -> Vec:
    (q, u), (n, d) = line, plane
    den = n.dot(u)
    return _only(F.abs(den) >= _TINY, q - u.scaled((n.dot(q) + d) / den))


def intersect_normal_plane(source: P, target: P, through: Vec | None = None) -> Vec:
    """Where the source's normal through a point (by default its foot from the origin) meets the target."""
    start = through if through is not None else source[0].scaled(-source[1])
    return intersect_line_plane((start, source[0]), target)


def line_from_point_normal(point: Vec, plane: P) -> L:
    return canonical_line(point, plane[0])


def line_from_two_points(a: Vec, b: Vec) -> L:
    w = b - a
    return canonical_line(a, _only(w.norm2() >= _TINY, w))


def midpoint_line_planes(line: L, a: P, b: P) -> Vec:
    return (intersect_line_plane(line, a) + intersect_line_plane(line, b)).scaled(0.5)


def plane_from_plane_point(plane: P, point: Vec) -> P:
    return canonical_plane(plane[0], -plane[0].dot(point))


def plane_from_line_point(line: L, point: Vec) -> P:
    """Through the point, its normal along the line."""
    return canonical_plane(line[1], -line[1].dot(point))


def plane_from_two_lines(a: L, b: L) -> P:
    """The plane of two lines that meet or are parallel; null for skew or equal ones."""
    (p1, u1), (p2, u2) = a, b
    w, t = p2 - p1, u1.cross(u2)
    parallel = t.norm2() < _TINY
    across = w - u1.scaled(w.dot(u1))
    n = across.cross(u1).where(parallel, t)
    skew = ~parallel & (F.abs(w.dot(t)) > _TINY * F.greatest(F.lit(1.0), w.norm()))
    return canonical_plane(_only(~skew & (n.norm2() >= _TINY), n), -n.dot(p1))


def _turned(v: Vec, axis: Vec, angle) -> Vec:
    """Rodrigues' rotation of a vector."""
    turn = F.radians(angle if isinstance(angle, Column) else F.lit(float(angle)))
    c, s = F.cos(turn), F.sin(turn)
    return v.scaled(c) + axis.cross(v).scaled(s) + axis.scaled(axis.dot(v) * (1 - c))


def rotate_point_about_line(point: Vec, line: L, angle) -> Vec:
    return line[0] + _turned(point - line[0], line[1], angle)


def rotate_plane_about_line(plane: P, line: L, angle) -> P:
    n = _turned(plane[0], line[1], angle)
    foot = rotate_point_about_line(plane[0].scaled(-plane[1]), line, angle)
    return canonical_plane(n, -n.dot(foot))


def rotate_line_about_line(line: L, axis: L, angle) -> L:
    return canonical_line(rotate_point_about_line(line[0], axis, angle), _turned(line[1], axis[1], angle))


def project_point_to_plane(p: Vec, plane: P) -> Vec:
    return p - plane[0].scaled(plane[0].dot(p) + plane[1])


def project_point_to_line(p: Vec, line: L) -> Vec:
    return line[0] + line[1].scaled((p - line[0]).dot(line[1]))


def distance_points(a: Vec, b: Vec) -> Column:
    return (b - a).norm()


def distance_point_plane(p: Vec, plane: P) -> Column:
    return F.abs(plane[0].dot(p) + plane[1])


def distance_point_line(p: Vec, line: L) -> Column:
    return (p - line[0]).cross(line[1]).norm()


def angle_planes(a: P, b: P) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(a[0].dot(b[0])))))


def angle_lines(a: L, b: L) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(a[1].dot(b[1])))))


def angle_line_plane(line: L, plane: P) -> Column:
    return F.degrees(F.asin(F.least(F.lit(1.0), F.abs(line[1].dot(plane[0])))))


def circumcircle(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Vec, Column]:
    """(center, unit normal, radius) through three points; null if they are on a line."""
    u, v = b - a, c - a
    n = u.cross(v)
    size = n.norm2()
    rel = n.cross(u).scaled(v.norm2()) + v.cross(n).scaled(u.norm2())
    rel = rel.over(2 * size)
    ok = size > 1e-18
    return _only(ok, a + rel), _only(ok, n.unit()), F.when(ok, rel.norm())
