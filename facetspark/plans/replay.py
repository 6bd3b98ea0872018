"""A recipe session over a table of surveys: edit a step, and only what depends on it is computed again.

A session is a checked recipe and a table that holds every entity computed so far as a struct
column.  Edits give a new session and leave the old one as it was, so a failed edit changes
nothing; what is not concerned keeps its columns.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .recipe import ALIGNED, MEASURES, Planner, Recipe, _operands, check_frame, check_measure, check_step
from .schema import migrate_recipe

_FRAME_REFS = (("axis", "line"), ("origin", "point"), ("yaw_line", "line"), ("yaw_plane", "plane"))


@dataclass(frozen=True)
class Session:
    recipe: Recipe
    table: DataFrame
    faces: tuple[str, ...]
    warnings: tuple[str, ...] = field(default=())

    @staticmethod
    def start(raw: dict, surveys: DataFrame) -> "Session":
        """A session of all surveys; each has a struct column for every face of the recipe."""
        recipe = Recipe.of(raw)
        faces = tuple(recipe.doc["faces"])
        if lost := [f for f in faces if f not in surveys.columns]:
            raise KeyError(f"surveys have no column for the faces {lost}")
        return Session(recipe, materialize(Planner(recipe, surveys).run(), "session"), faces)

    def unanswered(self) -> dict[str, int]:
        """Surveys without a geometric answer, by construct; only constructs that have some."""
        names = [s["id"] for s in self.recipe.steps]
        if not names:
            return {}
        structs = dict(self.table.dtypes)
        counts = [F.count_if(reduce(lambda a, b: a | b, [F.col(f"`{n}`.{f}").isNull() for f in _fields(structs[n])])).alias(f"c{i}") for i, n in enumerate(names)]
        row = self.table.agg(*counts).first()
        return {n: row[i] for i, n in enumerate(names) if row[i]}

    def _before(self, step_id: str) -> set[str]:
        out = set(self.faces)
        for s in self.recipe.steps:
            if s["id"] == step_id:
                break
            out.add(s["id"])
        return out

    def replace_step(self, step: dict) -> "Session":
        """The session with one construct changed (same id and op) and its dependents computed again.

        A frame or measure that no longer fits is dropped with a warning.  An edit after
        which more surveys lack an answer for some construct is an error.
        """
        name = str(step.get("id") or "")
        if name in self.faces:
            raise ValueError(f"{name!r} is a scanned face; it has no step")
        old = next((s for s in self.recipe.steps if s["id"] == name), None)
        if old is None:
            raise KeyError(f"{name!r} is not a construct step")
        new = migrate_recipe({"version": self.recipe.doc.get("version", 1), "construct": [dict(step)]})["construct"][0] if step.get("op") else dict(step)
        if new.get("op") != old["op"]:
            raise ValueError(f"cannot change the op of {name!r} from {old['op']!r} to {new.get('op')!r}")
        check_step(new, f"step {name!r}")
        used = {new[k] for k, _ in _operands(new)}
        if name in used:
            raise ValueError(f"{name!r} cannot reference itself")
        before = self._before(name)
        refs = {v for k, v in (self.recipe.doc["frame"] or {}).items() if k in dict(_FRAME_REFS)}
        allowed = before | (set(ALIGNED) if refs and refs <= before else set())
        if bad := sorted(used - allowed):
            raise ValueError(f"operand not available yet (it must be a face or an earlier construct): {bad}")
        doc = copy.deepcopy(self.recipe.doc)
        doc["construct"] = [new if s["id"] == name else s for s in doc["construct"]]
        return self._replayed(doc, {name, *self.recipe.dependents(name)})

    def rebind(self, face: str, value: Column) -> "Session":
        """The session with other values of a face (a Column over the table), and its dependents computed again."""
        if face not in self.faces:
            raise KeyError(f"{face!r} is not a face")
        moved = Session(self.recipe, self.table.withColumn(face, value), self.faces)
        return moved._replayed(copy.deepcopy(self.recipe.doc), set(self.recipe.dependents(face)), {face})

    def _replayed(self, doc: dict, stale: set[str], changed: set[str] = frozenset()) -> "Session":
        doc, warnings = _fitting(doc)
        recipe = Recipe.of(doc)
        touched = stale | changed
        refs = {v for k, v in (self.recipe.doc["frame"] or {}).items() if k in dict(_FRAME_REFS)}
        gone = set(stale)
        if refs & touched or recipe.doc["frame"] != self.recipe.doc["frame"]:
            gone |= {*ALIGNED, "__r"}
            touched = touched | set(ALIGNED)
        for m in self.recipe.doc.get("measures") or []:
            kept = any(m["id"] == x["id"] for x in recipe.doc.get("measures") or [])
            if not kept or {m[k] for k, _ in _operands(m)} & touched:
                gone.add(f"measure:{m['id']}")
        rest = self.table.select(*[F.col(f"`{c}`") for c in self.table.columns if c not in gone])
        out = Session(recipe, materialize(Planner(recipe, rest).run(), "session"), self.faces, tuple(warnings))
        was = self.unanswered()
        for name, n in out.unanswered().items():
            if n > was.get(name, 0):
                raise ValueError(f"{name}: parallel, coincident or skew operands in {n} surveys")
        return out

    def preview(self, step: dict) -> DataFrame:
        """The table with one more construct as a lazy column; nothing runs and the session stays as it is."""
        new = migrate_recipe({"version": self.recipe.doc.get("version", 1), "construct": [dict(step)]})["construct"][0]
        if not new.get("id"):
            raise ValueError("construct step needs id")
        if new["id"] in self.recipe.kinds:
            raise ValueError(f"preview id {new['id']!r} already exists")
        return Planner(self.recipe.with_step(new), self.table).run()

    def with_step(self, step: dict) -> "Session":
        """The session with one more construct, computed on what the table has."""
        recipe = self.recipe.with_step(step)
        return Session(recipe, materialize(Planner(recipe, self.table).run(), "session"), self.faces)

    def without(self, name: str) -> "Session":
        """The session without an entity and all that needs it."""
        recipe = self.recipe.without(name)
        keep = {*recipe.kinds, *(f"measure:{m['id']}" for m in recipe.doc.get("measures") or [])}
        framed = {*ALIGNED, "__r"} if recipe.doc["frame"] else set()
        known = {*self.recipe.kinds, *ALIGNED, "__r"}
        columns = [c for c in self.table.columns if c in keep | framed or (c not in known and not c.startswith("measure:"))]
        return Session(recipe, self.table.select(*[F.col(f"`{c}`") for c in columns]), tuple(f for f in self.faces if f in recipe.doc["faces"]))


def _fields(struct: str) -> list[str]:
    return [part.split(":")[0] for part in struct.removeprefix("struct<").removesuffix(">").split(",")]


def _fitting(doc: dict) -> tuple[dict, list[str]]:
    """The document without a frame and measures that its constructs do not carry, and a warning for each."""
    bare = Recipe.of({**doc, "frame": None, "measures": [], "export": None, "construct": [s for s in doc["construct"]]}) if not _uses_frame(doc) else None
    warnings: list[str] = []
    if bare is None:
        return doc, warnings
    frame = doc.get("frame")
    try:
        frame = check_frame(frame)
        for key, kind in _FRAME_REFS if frame else ():
            if key in frame and bare.kinds.get(frame[key]) != kind:
                raise ValueError(f"frame.{key}: {frame[key]!r} is not a {kind}")
    except ValueError as e:
        warnings.append(f"dropped frame: {e}")
        frame = None
    kinds = dict(bare.kinds) | (ALIGNED if frame else {})
    measures = []
    for m in doc.get("measures") or []:
        try:
            check_measure(m, "measure")
            for key, kind in MEASURES[m["op"]][0]:
                if kinds.get(m[key]) != kind:
                    raise ValueError(f"{m[key]!r} is not a {kind} any more")
            measures.append(m)
        except ValueError as e:
            warnings.append(f"dropped measure {m.get('id')!r}: {e}")
    return {**doc, "frame": frame, "measures": measures}, warnings


def _uses_frame(doc: dict) -> bool:
    return any(s.get(k) in ALIGNED for s in doc["construct"] for k, _ in _operands(s))
