"""Recipes: a document of faces, constructs, a frame and measures, planned as Columns over any number of surveys.

The analyzer works on the document alone; the planner turns each step into one struct
column, so a table with a row a survey is reduced by a single projection.
"""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Vec, canonical_plane
from ..operators import constructs as C
from ..scratch import materialize
from .schema import migrate_recipe

# The operations of the recipe language.
#: op: (result kind, operands with kinds, scalars, whether operands must differ)
CONSTRUCTS: dict[str, tuple[str, tuple[tuple[str, str], ...], tuple[str, ...], bool]] = {
    "offset": ("plane", (("plane", "plane"),), ("distance_mm",), False),
    "intersect_planes": ("line", (("plane_a", "plane"), ("plane_b", "plane")), (), True),
    "intersect_three_planes": ("point", (("plane_a", "plane"), ("plane_b", "plane"), ("plane_c", "plane")), (), False),
    "intersect_line_plane": ("point", (("line", "line"), ("plane", "plane")), (), False),
    "intersect_normal_plane": ("point", (("source_plane", "plane"), ("destination_plane", "plane")), (), False),
    "line_from_point_normal": ("line", (("point", "point"), ("plane", "plane")), (), False),
    "line_from_two_points": ("line", (("point_a", "point"), ("point_b", "point")), (), True),
    "midpoint_line_planes": ("point", (("line", "line"), ("plane_a", "plane"), ("plane_b", "plane")), (), True),
    "plane_from_plane_point": ("plane", (("plane", "plane"), ("point", "point")), (), False),
    "plane_from_line_point": ("plane", (("line", "line"), ("point", "point")), (), False),
    "plane_from_two_lines": ("plane", (("line_a", "line"), ("line_b", "line")), (), True),
    "rotate_plane_about_line": ("plane", (("plane", "plane"), ("line", "line")), ("angle_deg",), False),
    "rotate_point_about_line": ("point", (("point", "point"), ("line", "line")), ("angle_deg",), False),
    "rotate_line_about_line": ("line", (("line", "line"), ("axis", "line")), ("angle_deg",), True),
}

# The measures of the recipe language.
#: op: (operands with kinds, unit, prefix of automatic ids)
MEASURES: dict[str, tuple[tuple[tuple[str, str], ...], str, str]] = {
    "distance_points": ((("point_a", "point"), ("point_b", "point")), "mm", "dist"),
    "distance_point_plane": ((("point", "point"), ("plane", "plane")), "mm", "dplane"),
    "distance_point_line": ((("point", "point"), ("line", "line")), "mm", "dline"),
    "angle_planes": ((("plane_a", "plane"), ("plane_b", "plane")), "deg", "angp"),
    "angle_lines": ((("line_a", "line"), ("line_b", "line")), "deg", "angl"),
    "angle_line_plane": ((("line", "line"), ("plane", "plane")), "deg", "anglp"),
}

ALIGNED = {
    "aligned.origin": "point", "aligned.x": "line", "aligned.y": "line", "aligned.z": "line",
    "aligned.yz": "plane", "aligned.zx": "plane", "aligned.xy": "plane",
}
YAW = {"x": (1.0, 0.0), "-x": (-1.0, 0.0), "y": (0.0, 1.0), "-y": (0.0, -1.0)}
FACE_KINDS = {"": "plane", "plane": "plane", "face": "plane", "cylinder": "line", "circle": "point"}


def _operands(step: dict) -> tuple[tuple[str, str], ...]:
    return CONSTRUCTS[step["op"]][1] if step["op"] in CONSTRUCTS else MEASURES[step["op"]][0]


def check_step(step, where: str) -> dict:
    if not isinstance(step, dict):
        raise ValueError(f"{where}: not an object")
    if not step.get("id"):
        raise ValueError(f"{where}: needs id")
    if step["id"] in ALIGNED:
        raise ValueError(f"{where}: id {step['id']!r} is reserved")
    if step.get("op") not in CONSTRUCTS:
        raise ValueError(f"{where}: unknown op {step.get('op')!r}")
    _, operands, scalars, differ = CONSTRUCTS[step["op"]]
    used = []
    for key, _ in operands:
        if not step.get(key) or not isinstance(step[key], str):
            raise ValueError(f"{where}: needs {key}")
        used.append(step[key])
    if differ and len(set(used)) < len(used):
        raise ValueError(f"{where}: operands must differ")
    for key in scalars:
        try:
            float(step[key])
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"{where}: needs a number {key}") from e
    if "through" in step:
        try:
            if len([float(c) for c in step["through"]]) != 3:
                raise ValueError
        except (TypeError, ValueError) as e:
            raise ValueError(f"{where}: through must be three numbers") from e
    return step


def check_measure(spec, where: str) -> dict:
    if not isinstance(spec, dict) or spec.get("op") not in MEASURES:
        raise ValueError(f"{where}: unknown measure")
    name = str(spec.get("id") or "")
    if not name or any(c.isspace() for c in name):
        raise ValueError(f"{where}: needs an id without white space")
    used = [spec.get(key) for key, _ in MEASURES[spec["op"]][0]]
    if not all(used):
        raise ValueError(f"{where}: needs all operands")
    if len(set(used)) < len(used):
        raise ValueError(f"{where}: operands must differ")
    return spec


def check_frame(frame) -> dict | None:
    if frame is None:
        return None
    if not isinstance(frame, dict) or not frame.get("axis") or not frame.get("origin"):
        raise ValueError("frame: needs axis and origin")
    line, plane, to = frame.get("yaw_line"), frame.get("yaw_plane"), frame.get("yaw_to")
    if line and plane:
        raise ValueError("frame: yaw_line or yaw_plane, not both")
    if bool(line or plane) != bool(to):
        raise ValueError("frame: yaw_to goes with yaw_line or yaw_plane")
    if to and to not in YAW:
        raise ValueError(f"frame: yaw_to must be one of {sorted(YAW)}")
    out = {"axis": str(frame["axis"]), "origin": str(frame["origin"]), "flip_z": bool(frame.get("flip_z", False))}
    if to:
        out |= {"yaw_line": str(line)} if line else {"yaw_plane": str(plane)}
        out["yaw_to"] = to
    return out


@dataclass
class Recipe:
    """A checked document with the kind of each entity."""

    doc: dict
    kinds: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(raw: dict) -> "Recipe":
        if not isinstance(raw, dict):
            raise ValueError("a recipe is an object")
        if "faces" not in raw and "planes" in raw:
            raise ValueError("this is a geometry document, not a recipe")
        doc = migrate_recipe(raw)
        if doc.get("units", "mm") != "mm":
            raise ValueError("units must be mm")
        if not isinstance(doc.get("faces"), dict) or not doc["faces"]:
            raise ValueError("faces must be a non-empty object")
        for key in ("construct", "export", "measures"):
            if doc.get(key) is not None and not isinstance(doc[key], list):
                raise ValueError(f"{key} must be a list")
        self = Recipe(doc)
        for alias, spec in doc["faces"].items():
            self.kinds[alias] = _face_kind(alias, spec)
        doc["frame"] = check_frame(doc.get("frame"))
        for i, step in enumerate(doc.get("construct") or []):
            where = f"construct[{i}]"
            check_step(step, where)
            if step["id"] in self.kinds:
                raise ValueError(f"{where}: duplicate id {step['id']!r}")
            for key, kind in _operands(step):
                self._need(step[key], kind, f"{where}.{key}")
            self.kinds[step["id"]] = CONSTRUCTS[step["op"]][0]
        if doc["frame"]:
            for key, kind in (("axis", "line"), ("origin", "point"), ("yaw_line", "line"), ("yaw_plane", "plane")):
                if key in doc["frame"]:
                    if doc["frame"][key] in ALIGNED:
                        raise ValueError(f"frame.{key}: cannot be an aligned entity")
                    self._need(doc["frame"][key], kind, f"frame.{key}")
        names = set()
        for i, spec in enumerate(doc.get("measures") or []):
            check_measure(spec, f"measures[{i}]")
            if spec["id"] in names:
                raise ValueError(f"measures: duplicate id {spec['id']!r}")
            names.add(spec["id"])
            for key, kind in _operands(spec):
                self._need(spec[key], kind, f"measures[{i}].{key}")
        for name in doc.get("export") or []:
            if name not in self.kinds and name not in ALIGNED:
                raise KeyError(f"export: unknown id {name!r}")
        return self

    def _need(self, name: str, kind: str, where: str) -> None:
        got = ALIGNED.get(name) if name in ALIGNED else self.kinds.get(name)
        if got is None:
            raise KeyError(f"{where}: id {name!r} is not available yet")
        if got != kind:
            raise ValueError(f"{where}: {name!r} must be a {kind}")
        if name in ALIGNED:
            refs = [v for k, v in (self.doc["frame"] or {}).items() if k in ("axis", "origin", "yaw_line", "yaw_plane")]
            if not refs or any(r not in self.kinds for r in refs):
                raise KeyError(f"{where}: {name!r} is not available yet")

    @property
    def steps(self) -> list[dict]:
        return self.doc.get("construct") or []

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(self.doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def dependents(self, name: str) -> list[str]:
        """Ids of the steps that need ``name``, directly or not, in order; also through the frame."""
        gone = {name}
        frame = {v for k, v in (self.doc["frame"] or {}).items() if k in ("axis", "origin", "yaw_line", "yaw_plane")}
        while True:
            new = {s["id"] for s in self.steps if {s[k] for k, _ in _operands(s)} & (gone | (set(ALIGNED) if frame & gone else set()))} | gone
            if new == gone:
                return [s["id"] for s in self.steps if s["id"] in gone and s["id"] != name]
            gone = new

    def without(self, name: str) -> "Recipe":
        """The recipe without an entity and all that needs it."""
        gone = {name, *self.dependents(name)}
        doc = copy.deepcopy(self.doc)
        doc["faces"] = {k: v for k, v in doc["faces"].items() if k not in gone}
        doc["construct"] = [s for s in self.steps if s["id"] not in gone]
        if doc["frame"] and gone & set(map(str, doc["frame"].values())):
            doc["frame"] = None
        lost = gone | (set(ALIGNED) if self.doc["frame"] and not doc["frame"] else set())
        doc["measures"] = [m for m in doc.get("measures") or [] if not {m[k] for k, _ in _operands(m)} & lost]
        if doc.get("export") is not None:
            doc["export"] = [x for x in doc["export"] if x not in lost]
        return Recipe.of(doc)

    def renamed(self, old: str, new: str) -> "Recipe":
        if old not in self.kinds:
            raise KeyError(f"unknown id {old!r}")
        if new in self.kinds or new in ALIGNED or not new:
            raise ValueError(f"id {new!r} is taken or reserved")
        doc = copy.deepcopy(self.doc)
        doc["faces"] = {(new if k == old else k): v for k, v in doc["faces"].items()}
        for part in [*doc.get("construct", []), *(doc.get("measures") or []), *([doc["frame"]] if doc["frame"] else [])]:
            keys = [k for k, _ in _operands(part)] + (["id"] if part.get("op") in CONSTRUCTS else []) if "op" in part else list(part)
            part.update({k: new for k in keys if part.get(k) == old})
        if doc.get("export") is not None:
            doc["export"] = [new if x == old else x for x in doc["export"]]
        return Recipe.of(doc)

    def with_step(self, step: dict, replace: bool = False) -> "Recipe":
        """The recipe with one more step, or with the step of this id replaced; its op cannot change."""
        doc = copy.deepcopy(self.doc)
        if replace:
            at = next((i for i, s in enumerate(doc["construct"]) if s["id"] == step.get("id")), None)
            if at is None:
                raise KeyError(f"unknown step {step.get('id')!r}")
            if doc["construct"][at]["op"] != step.get("op"):
                raise ValueError("a step's op cannot change")
            doc["construct"][at] = dict(step)
        else:
            doc["construct"] = [*self.steps, dict(step)]
        return Recipe.of(doc)

    def with_measure(self, op: str, **operands: str) -> "Recipe":
        if op not in MEASURES:
            raise ValueError(f"unknown measure {op!r}")
        taken = {m["id"] for m in self.doc.get("measures") or []}
        prefix = MEASURES[op][2]
        k = 1
        while f"{prefix}{k}" in taken:
            k += 1
        return Recipe.of({**self.doc, "measures": [*(self.doc.get("measures") or []), {"id": f"{prefix}{k}", "op": op, **operands}]})


def _face_kind(alias: str, spec) -> str:
    if not isinstance(spec, dict):
        raise ValueError(f"faces.{alias}: not an object")
    if spec.get("from", "group") != "group":
        raise ValueError(f"faces.{alias}: only from group")
    if (spec.get("name") is None) == (spec.get("group_id") is None):
        raise ValueError(f"faces.{alias}: needs one of name and group_id")
    kind = str(spec.get("kind", "plane")).lower()
    if kind not in FACE_KINDS:
        raise ValueError(f"faces.{alias}: unknown kind {kind!r}")
    return FACE_KINDS[kind]


# Planning. Struct columns: plane (nx, ny, nz, d), line (px, py, pz, ux, uy, uz), point (x, y, z).

_FIELDS = {"plane": ("nx", "ny", "nz", "d"), "line": ("px", "py", "pz", "ux", "uy", "uz"), "point": ("x", "y", "z")}


def _unpack(name: str, kind: str):
    c = [F.col(f"`{name}`.{f}") for f in _FIELDS[kind]]
    if kind == "plane":
        return Vec(*c[:3]), c[3]
    return (Vec(*c[:3]), Vec(*c[3:])) if kind == "line" else Vec(*c)


def _pack(value, kind: str) -> Column:
    if kind == "plane":
        cols = [*(getattr(value[0], a) for a in "xyz"), value[1]]
    elif kind == "line":
        cols = [getattr(v, a) for v in value for a in "xyz"]
    else:
        cols = [getattr(value, a) for a in "xyz"]
    return F.struct(*[c.cast("double").alias(f) for c, f in zip(cols, _FIELDS[kind], strict=True)])


def rotation_to_z(d: Vec) -> list[Vec]:
    """Rows of the smallest rotation that takes a unit direction to +z; half a turn if it points to -z."""
    c = d.z
    k = F.when(1 + c > 1e-12, 1 / (1 + c)).otherwise(0.0)
    rows = [
        Vec(1 - d.x * d.x * k, -(d.x * d.y * k), -d.x),
        Vec(-(d.x * d.y * k), 1 - d.y * d.y * k, -d.y),
        Vec(d.x, d.y, c),
    ]
    down = c < -1.0 + 1e-12
    half = [Vec.of(1, 0, 0), Vec.of(0, -1, 0), Vec.of(0, 0, -1)]  # about x
    same = c > 1.0 - 1e-12
    eye = [Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1)]
    return [e.where(same, h.where(down, r)) for r, h, e in zip(rows, half, eye, strict=True)]


def _turn(rows: list[Vec], v: Vec) -> Vec:
    return Vec(*(r.dot(v) for r in rows))


class Planner:
    """Adds a struct column for each entity of a recipe to a table of surveys."""

    def __init__(self, recipe: Recipe, surveys: DataFrame):
        self.recipe, self.frame, self.df = recipe, recipe.doc["frame"], surveys
        self.kinds = dict(recipe.kinds) | ALIGNED
        self._framed = "__r" in surveys.columns

    def _get(self, name: str):
        if name in ALIGNED and not self._framed:
            self._add_frame()
        return _unpack(name, self.kinds[name])

    def _keep(self) -> None:
        """Keep what is computed so far as one projection.

        The optimizer would write each entity's formula out at every use, which doubles
        with each step; it does not merge projections across a filter that is not
        deterministic.  This one lets every row through.
        """
        self.df = self.df.filter(F.monotonically_increasing_id() >= 0)

    def _put(self, name: str, value) -> None:
        self.df = self.df.withColumn(name, _pack(value, self.kinds[name]))
        self._keep()

    def _add_frame(self) -> None:
        f = self.frame
        d = _unpack(f["axis"], "line")[1]
        d = d.scaled(F.lit(-1.0 if f["flip_z"] else 1.0))
        rows = rotation_to_z(d)
        self.df = self.df.withColumn("__r", F.struct(*[c.alias(f"{a}{i}") for i, r in enumerate(rows) for a, c in zip("xyz", (r.x, r.y, r.z), strict=True)]))
        self._keep()
        rows = [Vec(*(F.col(f"__r.{a}{i}") for a in "xyz")) for i in range(3)]
        if "yaw_to" in f:
            ref = _unpack(f["yaw_line"], "line")[1] if "yaw_line" in f else _unpack(f["yaw_plane"], "plane")[0]
            seen = _turn(rows, ref)
            size = F.sqrt(seen.x * seen.x + seen.y * seen.y)
            tx, ty = YAW[f["yaw_to"]]
            ok = size >= 1e-12  # a reference along z gives nulls
            cos, sin = F.when(ok, (seen.x * tx + seen.y * ty) / size), F.when(ok, (seen.x * ty - seen.y * tx) / size)
            turned = [rows[0].scaled(cos) - rows[1].scaled(sin), rows[0].scaled(sin) + rows[1].scaled(cos), rows[2]]
            self.df = self.df.withColumn("__r", F.struct(*[c.alias(f"{a}{i}") for i, r in enumerate(turned) for a, c in zip("xyz", (r.x, r.y, r.z), strict=True)]))
        self._keep()
        self._framed = True
        origin = _unpack(f["origin"], "point")
        axes = [Vec(*(F.col(f"__r.{a}{i}") for a in "xyz")) for i in range(3)]
        values = {"aligned.origin": origin}
        values |= {f"aligned.{a}": (origin, v) for a, v in zip("xyz", axes, strict=True)}
        values |= {f"aligned.{p}": canonical_plane(v, -v.dot(origin)) for p, v in zip(("yz", "zx", "xy"), axes, strict=True)}
        self.df = self.df.withColumns({k: _pack(v, ALIGNED[k]) for k, v in values.items()})
        self._keep()

    def run(self) -> DataFrame:
        """The surveys with a struct a construct, ``measure:<id>`` doubles and, with a frame, aligned structs.

        What the table has already is kept: only missing columns are planned.
        """
        have = set(self.df.columns)
        for step in self.recipe.steps:
            if step["id"] in have:
                continue
            args = [self._get(step[k]) for k, _ in _operands(step)]
            op: Callable = getattr(C, step["op"])
            args += [F.lit(float(step[k])) for k in CONSTRUCTS[step["op"]][2]]
            if step["op"] == "intersect_normal_plane" and "through" in step:
                args.append(Vec.of(*step["through"]))
            self._put(step["id"], op(*args))
        for m in self.recipe.doc.get("measures") or []:
            if f"measure:{m['id']}" in have:
                continue
            args = [self._get(m[k]) for k, _ in _operands(m)]
            self.df = self.df.withColumn(f"measure:{m['id']}", getattr(C, m["op"])(*args))
        if self.frame and not self._framed:
            self._add_frame()
        return self.df

    def in_frame(self, name: str) -> Column:
        """An entity's struct seen from the frame."""
        rows = [Vec(*(F.col(f"__r.{a}{i}") for a in "xyz")) for i in range(3)]
        origin = _unpack(self.frame["origin"], "point")
        kind = self.kinds[name]
        v = _unpack(name, kind)
        if kind == "plane":
            return _pack(canonical_plane(_turn(rows, v[0]), v[1] + v[0].dot(origin)), kind)
        if kind == "line":
            return _pack(C.canonical_line(_turn(rows, v[0] - origin), _turn(rows, v[1])), kind)
        return _pack(_turn(rows, v - origin), kind)


def entity_table(df: DataFrame, kinds: dict[str, str], key: str, structs: dict[str, Column] | None = None) -> DataFrame:
    """(key, id, kind, v1 ... v6), a row a survey and entity: its numbers in order, null beyond them.

    ``structs`` gives entities other values than the table's columns of their names.
    """
    if structs:  # written out first: an array of many formulas is too long for one generated method
        df = materialize(df.select(key, *[structs.get(name, F.col(f"`{name}`")).alias(name) for name in kinds]), "entities")
    rows = []
    for name, kind in kinds.items():
        s = F.col(f"`{name}`")
        numbers = [F.round(s.getField(f), 6) + 0.0 for f in _FIELDS[kind]]
        rows.append(F.struct(F.lit(name).alias("id"), F.lit(kind).alias("kind"), F.array(*numbers, *[F.lit(None).cast("double")] * (6 - len(numbers))).alias("v")))
    flat = df.select(key, F.explode(F.array(*rows)).alias("e"))
    return flat.select(key, "e.id", "e.kind", *[F.col("e.v")[i].alias(f"v{i + 1}") for i in range(6)])


def one_survey(spark: SparkSession, faces: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """A one-row table of faces: (kind, numbers) by alias; a plane is n and d, a line p and u."""
    df = spark.range(1).select(F.lit("survey").alias("survey_id"))
    for alias, (kind, numbers) in faces.items():
        v = [F.lit(float(x)) for x in numbers]
        value = canonical_plane(Vec(*v[:3]), v[3]) if kind == "plane" else C.canonical_line(Vec(*v[:3]), Vec(*v[3:])) if kind == "line" else Vec(*v)
        df = df.withColumn(alias, _pack(value, kind))
    return df


def _record(kind: str, s, **more) -> dict:
    v = list(s)
    own = {"normal": v[:3], "d": v[3]} if kind == "plane" else {"point": v[:3], "direction": v[3:]} if kind == "line" else {"xyz": v}
    return {"kind": kind, **own, **more}


_PROVENANCE = {"offset": "offset", "intersect_planes": "intersection", "intersect_three_planes": "intersection", "intersect_line_plane": "intersection", "intersect_normal_plane": "intersection"}


def reduce_survey(spark: SparkSession, raw: dict, faces: dict[str, tuple[str, list[float]]], source_project: str = "", quality: dict | None = None) -> dict:
    """The geometry document of one survey.  A construct without a geometric answer is an error."""
    recipe = Recipe.of(raw)
    plan = Planner(recipe, one_survey(spark, faces))
    df = plan.run()
    if recipe.doc["frame"]:
        df = df.withColumns({f"in:{k}": plan.in_frame(k) for k in recipe.kinds})
    row = df.first()
    out: dict = {"version": 1, "units": "mm", "source_project": source_project, "recipe": {"sha256": recipe.sha256(), "echo": recipe.doc}, "planes": {}, "lines": {}, "points": {}}
    aligned: dict = {"planes": {}, "lines": {}, "points": {}}
    steps = {s["id"]: s for s in recipe.steps}
    for name, kind in recipe.kinds.items():
        if any(v is None for v in row[name]):
            raise ValueError(f"{name}: parallel, coincident or skew operands")
        if name in steps:
            s = steps[name]
            more = {"provenance": _PROVENANCE.get(s["op"], "constructed"), "op": s["op"], "parents": [s[k] for k, _ in _operands(s)]}
            more |= {k: float(s[k]) for k in CONSTRUCTS[s["op"]][2]}
        else:
            more = {"provenance": "scanned", **((quality or {}).get(name) or {})}
        out[f"{kind}s"][name] = _record(kind, row[name], **more)
        if recipe.doc["frame"]:
            aligned[f"{kind}s"][name] = _record(kind, row[f"in:{name}"], **more)
    out["export"] = list(recipe.doc.get("export") or recipe.kinds)
    if recipe.doc["frame"]:
        if any(v is None for v in row["__r"]):
            raise ValueError("frame: the yaw reference is parallel to z")
        r = list(row["__r"])
        out["frame"] = {"kind": "aligned", **recipe.doc["frame"], "origin_xyz": list(row[recipe.doc["frame"]["origin"]]), "rotation": [r[:3], r[3:6], r[6:]]}
        out["aligned"] = aligned
    if recipe.doc.get("measures"):
        out["measures"] = [{**m, "value": row[f"measure:{m['id']}"], "unit": MEASURES[m["op"]][1]} for m in recipe.doc["measures"]]
    return out


def geometry_summary(geometry: dict) -> dict:
    """Names and coordinates of what is exported, in that order; seen from the frame if there is one."""
    source = geometry.get("aligned") or geometry
    out: dict = {"units": "mm", "frame": "aligned" if geometry.get("aligned") else "survey"}
    for kind, keys in (("planes", ("normal", "d")), ("lines", ("point", "direction")), ("points", ("xyz",))):
        have = source.get(kind) or {}
        names = [n for n in geometry.get("export") or list(have) if n in have]
        out[kind] = {n: {k: have[n][k] for k in keys} for n in names}
    return out


def entity_rows(spark: SparkSession, geometry: dict) -> DataFrame:
    """(id, kind, v1 ... v6) of a geometry document: the record's numbers in order, null beyond them."""
    rows = []
    for kind, keys in (("planes", ("normal", "d")), ("lines", ("point", "direction")), ("points", ("xyz",))):
        for name, rec in geometry[kind].items():
            flat = [x for k in keys for x in (rec[k] if isinstance(rec[k], list) else [rec[k]])]
            flat = [round(float(x), 6) + 0.0 for x in flat]
            rows.append((name, kind[:-1], *flat, *[None] * (6 - len(flat))))
    return spark.createDataFrame(rows, "id string, kind string, " + ", ".join(f"v{i} double" for i in range(1, 7)))
