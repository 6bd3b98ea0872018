"""Geometry on Column triples: everything stays inside whole-stage code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vec:
    """Three Columns, or numbers turned into literals."""

    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(x, y, z) -> "Vec":
        return Vec(*(c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z)))

    @staticmethod
    def cols(*names: str) -> "Vec":
        return Vec(*(F.col(n) for n in names))

    def __add__(self, o: "Vec") -> "Vec":
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def scaled(self, k) -> "Vec":
        return Vec(self.x * k, self.y * k, self.z * k)

    def over(self, k) -> "Vec":
        return Vec(self.x / k, self.y / k, self.z / k)

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def unit(self) -> "Vec":
        return self.over(self.norm())

    def where(self, condition: Column, other: "Vec") -> "Vec":
        """Self where the condition holds, else the other."""
        return Vec(*(F.when(condition, a).otherwise(b) for a, b in ((self.x, other.x), (self.y, other.y), (self.z, other.z))))

    def named(self, *names: str) -> list[Column]:
        return [c.alias(n) for c, n in zip((self.x, self.y, self.z), names, strict=True)]


def canonical_sign(n: Vec) -> Column:
    """+1 or -1: what makes the first component of largest size non-negative."""
    ax, ay, az = F.abs(n.x), F.abs(n.y), F.abs(n.z)
    main = F.when((ax >= ay) & (ax >= az), n.x).when(ay >= az, n.y).otherwise(n.z)
    return F.when(main < 0, -1.0).otherwise(1.0)


def canonical_plane(n: Vec, d: Column) -> tuple[Vec, Column]:
    """Unit normal of canonical sign and the offset that goes with it; null for a zero normal."""
    size = n.norm()
    k = F.when(size > 0, canonical_sign(n) / size)
    return n.scaled(k), d * k


def inplane_basis(n: Vec) -> tuple[Vec, Vec]:
    """(u, v) across a unit normal: u = n x a with a = x unless n is nearly along it, v = n x u."""
    near_x = F.abs(n.x) > 0.9
    u = n.cross(Vec.of(0, 1, 0)).where(near_x, n.cross(Vec.of(1, 0, 0))).unit()
    return u, n.cross(u)


def signed_distance(p: Vec, n: Vec, d) -> Column:
    return n.dot(p) + d


def axis_distance(p: Vec, point: Vec, direction: Vec) -> Column:
    """Distance of p from the line through ``point`` along the unit ``direction``."""
    w = p - point
    t = w.dot(direction)
    return F.sqrt(F.greatest(w.norm2() - t * t, F.lit(0.0)))


def voxel(p: Vec, low: Vec, cell: float) -> list[Column]:
    return [F.floor((a - b) / F.lit(float(cell))).cast("long") for a, b in ((p.x, low.x), (p.y, low.y), (p.z, low.z))]


def bin_index(value: Column, low, high, bins: int) -> Column:
    """Bin of a histogram over [low, high]; the last bin is closed, values outside are null.

    Where low = high the range widens by a half on either side.
    """
    flat = F.lit(high) == F.lit(low)
    lo = F.when(flat, F.lit(low) - 0.5).otherwise(F.lit(low))
    hi = F.when(flat, F.lit(high) + 0.5).otherwise(F.lit(high))
    index = F.floor((value - lo) / (hi - lo) * F.lit(bins)).cast("long")
    return F.when((value >= lo) & (value <= hi), F.least(index, F.lit(bins - 1)))


#: Masks that leave two zero bits between the bits of a number, and the shifts before them.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(c: Column) -> Column:
    for shift, mask in _SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(cells: list[Column]) -> Column:
    """The code whose bits are those of three cell numbers in turn."""
    i, j, k = (_spread(c.cast("long")) for c in cells)
    return F.shiftleft(i, 2).bitwiseOR(F.shiftleft(j, 1)).bitwiseOR(k)


def fine_code(parts: list[Column]) -> Column:
    """The code of a place inside a cell, given as parts of its sides, in sixteenths: an order in which neighbours lie together."""
    return morton([F.greatest(F.lit(0), F.least(F.lit(15), F.floor(c * 16).cast("long"))) for c in parts])
