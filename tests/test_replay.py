"""Sessions over surveys: edits, what they compute again, and edits that fail; constructs by their own properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.functions.columns import Vec
from facetspark.operators import constructs as C
from facetspark.plans.recipe import _pack
from facetspark.plans.replay import Session

RECIPE = {
    "faces": {"left": {"name": "left"}, "front": {"name": "front"}, "top": {"name": "top"}},
    "construct": [
        {"id": "left_in", "op": "offset", "plane": "left", "distance_mm": 50}, {"id": "front_in", "op": "offset", "plane": "front", "distance_mm": 20},
        {"id": "axis", "op": "intersect_planes", "plane_a": "left_in", "plane_b": "front_in"}, {"id": "target", "op": "intersect_line_plane", "line": "axis", "plane": "top"},
        {"id": "extra", "op": "offset", "plane": "top", "distance_mm": 5},
    ],
    "frame": {"axis": "axis", "origin": "target", "yaw_plane": "left", "yaw_to": "x"},
    "measures": [{"id": "to_left", "op": "distance_point_plane", "point": "target", "plane": "left"}, {"id": "gap", "op": "angle_planes", "plane_a": "left", "plane_b": "top"}],
}


def plane(n, d):
    return _pack((Vec.of(*n), F.col("survey_id").cast("double") * 0 + d), "plane")


@pytest.fixture(scope="module")
def session(spark):
    s = spark.range(3).select(F.col("id").alias("survey_id"))
    s = s.select("survey_id", plane((1, 0, 0), 50).alias("left"), plane((0, 1, 0), 20).alias("front"), _pack((Vec.of(0, 0, 1), -100.0 - F.col("survey_id")), "plane").alias("top"))
    return Session.start(RECIPE, s)


def at(session, name, survey=0):
    return tuple(session.table.filter(F.col("survey_id") == survey).select(f"`{name}`.*" if ":" not in name else f"`{name}`").first())


def test_a_changed_step_moves_what_needs_it(session):
    assert at(session, "target") == pytest.approx((0, 0, 100)) and at(session, "measure:to_left") == pytest.approx((50,))
    new = session.replace_step({"id": "left_in", "op": "offset", "of": "left", "distance_mm": 40})
    assert [s["id"] for s in new.recipe.steps] == ["left_in", "front_in", "axis", "target", "extra"]
    for k in range(3):
        assert at(new, "target", k) == pytest.approx((-10, 0, 100 + k)) and at(new, "extra", k) == at(session, "extra", k)
    assert at(new, "measure:to_left") == pytest.approx((40,)) and at(new, "aligned.origin") == pytest.approx((-10, 0, 100))
    assert at(session, "target") == pytest.approx((0, 0, 100)) and not new.warnings


def test_only_dependents_are_planned_again(session, monkeypatch):
    from facetspark.plans import recipe

    planned = []
    put = recipe.Planner._put
    monkeypatch.setattr(recipe.Planner, "_put", lambda self, name, value: (planned.append(name), put(self, name, value))[1])
    session.replace_step({"id": "front_in", "op": "offset", "plane": "front", "distance_mm": 21})
    assert planned == ["front_in", "axis", "target"]


@pytest.mark.parametrize("step, error, message", [
    ({"id": "left_in", "op": "offset", "plane": "axis", "distance_mm": 1}, ValueError, "not available yet"),
    ({"id": "left_in", "op": "offset", "plane": "left_in", "distance_mm": 1}, ValueError, "cannot reference itself"),
    ({"id": "left", "op": "offset", "plane": "top", "distance_mm": 1}, ValueError, "scanned face"),
    ({"id": "nobody", "op": "offset", "plane": "top", "distance_mm": 1}, KeyError, "not a construct"),
    ({"id": "left_in", "op": "intersect_planes", "plane_a": "left", "plane_b": "front"}, ValueError, "cannot change the op"),
    ({"id": "left_in", "op": "offset", "plane": "front", "distance_mm": 20}, ValueError, "parallel"),
])
def test_edits_that_fail_change_nothing(session, step, error, message):
    before = [dict(s) for s in session.recipe.steps]
    with pytest.raises(error, match=message):
        session.replace_step(step)
    assert [dict(s) for s in session.recipe.steps] == before and at(session, "target") == pytest.approx((0, 0, 100))


def test_a_preview_is_lazy_and_leaves_the_session(session):
    jobs = session.table.sparkSession.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    shown = session.preview({"id": "tmp", "op": "offset", "of": "left", "distance_mm": 12})
    assert len(jobs.getJobIdsForGroup()) == before
    assert tuple(shown.select("tmp.*").first()) == pytest.approx((1, 0, 0, 38)) and "tmp" not in session.recipe.kinds
    with pytest.raises(ValueError, match="already exists"):
        session.preview({"id": "axis", "op": "offset", "plane": "left", "distance_mm": 1})


def test_faces_steps_and_removals(session):
    moved = session.rebind("left", plane((1, 0, 0), 60))
    assert at(moved, "target") == pytest.approx((-10, 0, 100)) and at(moved, "measure:to_left") == pytest.approx((50,))
    more = session.with_step({"id": "corner", "op": "intersect_three_planes", "plane_a": "left", "plane_b": "front", "plane_c": "top"})
    assert at(more, "corner") == pytest.approx((-50, -20, 100))
    less = more.without("axis")
    assert [s["id"] for s in less.recipe.steps] == ["left_in", "front_in", "extra", "corner"] and less.recipe.doc["frame"] is None
    assert [m["id"] for m in less.recipe.doc["measures"]] == ["gap"] and "target" not in less.table.columns and "measure:gap" in less.table.columns
    with pytest.raises(KeyError, match="no column"):
        Session.start(RECIPE, session.table.select("survey_id", "left"))


def test_constructs_meet_their_own_conditions(spark):
    """Points of an intersection lie on both planes, whatever the formula."""
    from facetspark.functions.columns import canonical_plane

    rng = np.random.default_rng(0)
    names = [f"{p}{c}" for p in "abc" for c in ("x", "y", "z", "d")] + [f"{p}{c}" for p in "pquv" for c in "xyz"]
    raw = spark.createDataFrame([[float(v) for v in rng.normal(size=len(names)) * 5] for _ in range(30)], ", ".join(f"{n} double" for n in names))
    # Planes and lines as plain numbers first: formulas of formulas grow too long.
    flat = []
    for k in "abc":
        n, d = canonical_plane(Vec.cols(f"{k}x", f"{k}y", f"{k}z"), F.col(f"{k}d"))
        flat += [*n.named(f"{k}x", f"{k}y", f"{k}z"), d.alias(f"{k}d")]
    for k in "uv":
        flat += C.canonical_line(Vec.cols("px", "py", "pz"), Vec.cols(f"{k}x", f"{k}y", f"{k}z"))[1].named(f"{k}x", f"{k}y", f"{k}z")
    flat += [F.col(f"{p}{c}") for p in "pq" for c in "xyz"]
    rows = raw.select(*flat).collect()
    df = spark.createDataFrame(rows)
    a, b, c = ((Vec.cols(f"{p}x", f"{p}y", f"{p}z"), F.col(f"{p}d")) for p in "abc")
    p, q, u, v = (Vec.cols(f"{k}x", f"{k}y", f"{k}z") for k in "pquv")
    made = {
        "cut": (C.intersect_planes(a, b), "line"), "three": (C.intersect_three_planes(a, b, c), "point"), "hit": (C.intersect_line_plane((p, u), a), "point"),
        "two": (C.plane_from_two_lines((p, u), (p, v)), "plane"), "hinge": (C.rotate_plane_about_line(a, (p, u), 33.0), "plane"), "spun": (C.rotate_point_about_line(q, (p, u), 33.0), "point"),
        "moved": (C.offset(a, 2.5), "plane"), "foot": (C.project_point_to_plane(q, a), "point"), "flat": (C.plane_from_plane_point(a, q), "plane"), "across": (C.plane_from_line_point((p, u), q), "plane"),
    }
    got = {k: np.array([tuple(r[0]) for r in df.select(_pack(value, kind)).collect()]) for k, (value, kind) in made.items()}
    x = {k: np.array([[r[f"{k}{c}"] for c in ("xyzd" if k in "abc" else "xyz")] for r in rows]) for k in "abcpquv"}
    on = lambda point, plane_: np.abs((point * plane_[:, :3]).sum(axis=1) + plane_[:, 3]).max()
    along = lambda point, line_u: np.linalg.norm(np.cross(point - x["p"], line_u), axis=1)
    cut = got["cut"]
    assert max(on(cut[:, :3], x["a"]), on(cut[:, :3], x["b"]), np.abs((cut[:, :3] * cut[:, 3:]).sum(axis=1)).max()) < 1e-6
    assert max(np.abs((cut[:, 3:] * x[k][:, :3]).sum(axis=1)).max() for k in "ab") < 1e-9
    assert max(on(got["three"], x[k]) for k in "abc") < 1e-6 and on(got["hit"], x["a"]) < 1e-6 and along(got["hit"], x["u"]).max() < 1e-6
    assert max(on(x["p"], got["two"]), on(x["p"] + x["u"], got["two"]), on(x["p"] + x["v"], got["two"])) < 1e-6
    assert on(got["hit"], got["hinge"]) < 1e-5 and np.abs(along(x["q"], x["u"]) - along(got["spun"], x["u"])).max() < 1e-9
    assert got["moved"][:, 3] == pytest.approx(x["a"][:, 3] - 2.5) and on(got["foot"], x["a"]) < 1e-9
    assert max(on(x["q"], got["flat"]), on(x["q"], got["across"])) < 1e-9 and got["across"][:, :3] == pytest.approx(x["u"])
