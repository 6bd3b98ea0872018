"""Planes, cylinders and circles as JSON records, and back."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..operators.planes import Plane


@dataclass(frozen=True)
class Round:
    """A cylinder (a point and a direction) or a circle (a center and a normal) with its diameter in mm."""

    kind: str
    at: tuple[float, float, float]
    along: tuple[float, float, float]
    diameter_mm: float
    diameter_fixed: bool = False


# What the records call the place and the direction of a round.
_NAMES = {"cylinder": ("point", "direction"), "circle": ("center", "normal")}


def plane_record(plane: Plane) -> dict:
    return {"normal": list(plane.normal), "d": plane.d}


def plane_of(record) -> Plane:
    """From normal and d, from abcd, or from four numbers."""
    if isinstance(record, dict):
        if "normal" in record and "d" in record:
            return Plane.of(record["normal"], record["d"])
        if "abcd" in record:
            return Plane.from_array(record["abcd"])
        raise ValueError("a plane record needs normal and d, or abcd")
    if isinstance(record, str) or not hasattr(record, "__len__"):
        raise TypeError(f"a plane record is an object or four numbers, not {type(record).__name__}")
    return Plane.from_array(record)


def round_record(item: Round) -> dict:
    at, along = _NAMES[item.kind]
    return {at: list(item.at), along: list(item.along), "diameter_mm": item.diameter_mm, "diameter_fixed": item.diameter_fixed}


def round_of(kind: str, record) -> Round:
    """A cylinder or circle of a record; the direction becomes a unit vector."""
    if not isinstance(record, dict):
        raise TypeError(f"a {kind} record is an object, not {type(record).__name__}")
    at, along = _NAMES[kind]
    if lost := [k for k in (at, along, "diameter_mm") if k not in record]:
        raise ValueError(f"a {kind} record needs {', '.join(lost)}")
    u = [float(c) for c in record[along]]
    size = math.sqrt(sum(c * c for c in u))
    if len(u) != 3 or len(record[at]) != 3 or not math.isfinite(size) or size == 0:
        raise ValueError(f"a {kind} record needs three finite numbers for {at} and {along}")
    return Round(kind, tuple(float(c) for c in record[at]), tuple(c / size for c in u), float(record["diameter_mm"]), bool(record.get("diameter_fixed", False)))
