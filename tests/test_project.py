"""Projects on disk: documents, codecs, faces bound with a hook and a diameter of the recipe's own, and the command line."""

import hashlib
import json

import pytest

from facetspark import __version__
from facetspark.__main__ import main
from facetspark.operators.planes import Plane
from facetspark.plans import codecs, schema
from facetspark.plans.recipe import Recipe
from facetspark.sources import project as P

GROUPS = [
    {"group_id": 3, "name": "top", "fit": {"planes": [{"plane_index": 0, "normal": [0, 0, 2], "d": -200, "junk": 1}]}},
    {"group_id": 1, "name": "left", "fit": {"planes": [{"plane_index": 0, "abcd": [1, 0, 0, 50]}, {"plane_index": 1, "normal": [0, 1, 0], "d": 20}]}},
    {"group_id": 2, "name": "pipe", "fit": {"cylinders": [{"cylinder_index": 0, "point": [1, 2, 3], "direction": [0, 0, 4], "diameter_mm": 30}], "circles": [{"circle_index": 1, "center": [5, 6, 7], "normal": [0, 0, 1], "diameter_mm": 8}]}},
]
RECIPE = {
    "version": 2, "units": "mm", "faces": {"left": {"name": "left"}, "front": {"name": "left", "plane_index": 1}, "top": {"group_id": 3}, "axis": {"name": "pipe", "kind": "cylinder", "diameter_mm": 31}, "hole": {"name": "pipe", "kind": "circle", "circle_index": 1}},
    "construct": [{"id": "corner", "op": "intersect_three_planes", "plane_a": "left", "plane_b": "front", "plane_c": "top"}], "measures": [{"id": "m", "op": "distance_point_line", "point": "corner", "line": "axis"}],
}


@pytest.fixture
def folder(tmp_path):
    for g in GROUPS:
        P.save_group(str(tmp_path), g)
    return str(tmp_path)


def test_documents_round_trip(folder, tmp_path):
    docs = P.load_groups(folder)
    assert [d["group_id"] for d in docs] == [1, 2, 3] and docs[0]["fit"]["planes"][0]["normal"] == [1.0, 0.0, 0.0] and "junk" not in docs[2]["fit"]["planes"][0]
    P.save_settings(folder, P.Settings(display_voxel_mm=2.5))
    assert P.load_settings(folder) == (P.Settings(display_voxel_mm=2.5), [])
    (tmp_path / "settings.json").write_text(json.dumps({"ransac_backend": "numpy", "compute_backend": "gpu", "what": 1}))
    assert P.load_settings(folder) == (P.Settings(), ["what"])
    assert P.load_manifest(folder) == {} and P.load_settings(str(tmp_path / "none")) == (P.Settings(), [])
    P.save_manifest(folder, "scan.ply", 12)
    assert P.load_manifest(folder)["num_points"] == 12
    assert P.sha256_file(str(tmp_path / "manifest.json")) == hashlib.sha256((tmp_path / "manifest.json").read_bytes()).hexdigest()


def test_points_and_numbers_of_a_group(spark, tmp_path):
    points = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in (9, 4, 7)], "point_id long, x double, y double, z double")
    inliers = spark.createDataFrame([("p0", 7), ("p1", 4), ("p1", 9)], "entity string, point_id long")
    P.save_group(str(tmp_path), {"group_id": 5, "name": "g"}, points, inliers)
    assert sorted(tuple(r) for r in P.load_inliers(spark, str(tmp_path), 5).select("entity", "point_id", "local_idx").collect()) == [("p0", 7, 1), ("p1", 4, 0), ("p1", 9, 2)]
    assert P.load_inliers(spark, str(tmp_path), 6) is None
    with pytest.raises(ValueError, match="not points of the group"):
        P.save_group(str(tmp_path), {"group_id": 5, "name": "g"}, points, spark.createDataFrame([("p0", 8)], "entity string, point_id long"))


def test_faces_are_bound(folder):
    faces = P.bind_faces(folder, Recipe.of(RECIPE).doc)
    assert faces["left"] == ("plane", [1, 0, 0, 50]) and faces["front"] == ("plane", [0, 1, 0, 20]) and faces["top"] == ("plane", [0, 0, 1, -100])
    assert faces["axis"] == ("line", [1, 2, 3, 0, 0, 1]) and faces["hole"] == ("point", [5, 6, 7])
    assert P.face_diameters(folder, RECIPE) == {"axis": {"diameter_mm": 31.0, "diameter_fixed": True}, "hole": {"diameter_mm": 8.0, "diameter_fixed": False}}
    seen = []
    own = P.bind_faces(folder, RECIPE, lambda alias, spec: (seen.append(alias), ("plane", [0, 0, 1, 5]) if alias == "top" else None)[1])
    assert own["top"] == ("plane", [0, 0, 1, 5]) and own["left"] == faces["left"] and seen == list(RECIPE["faces"])
    for bad, error, message in ({"name": "nobody"}, KeyError, "nobody"), ({"name": "left", "plane_index": 7}, KeyError, "no single fit"):
        with pytest.raises(error, match=message):
            P.bind_faces(folder, {"faces": {"x": bad}})
    with pytest.raises(ValueError, match="no project"):
        P.bind_faces(None, RECIPE, lambda alias, spec: None)
    with pytest.raises(ValueError, match="need a project"):
        P.bind_faces(None, RECIPE)
    with pytest.raises(NotADirectoryError):
        P.bind_faces(folder + "/none", RECIPE)


def test_codecs():
    plane = Plane.of((0, 0, -2), 6)
    assert codecs.plane_of(codecs.plane_record(plane)) == codecs.plane_of({"abcd": [0, 0, -2, 6]}) == codecs.plane_of([0, 0, -2, 6]) == plane
    for kind in ("cylinder", "circle"):
        item = codecs.Round(kind, (1.0, 2.0, 3.0), (0.0, 0.6, 0.8), 12.5, True)
        assert codecs.round_of(kind, codecs.round_record(item)) == item
        with pytest.raises(ValueError, match="diameter_mm"):
            codecs.round_of(kind, {k: v for k, v in codecs.round_record(item).items() if k != "diameter_mm"})
        with pytest.raises(TypeError):
            codecs.round_of(kind, [1, 2])
    for bad, error in (({}, ValueError), ("abcd", TypeError), (3, TypeError), ([1, 2, 3], ValueError), ({"normal": [0, 0, 0], "d": 1}, ValueError)):
        with pytest.raises(error):
            codecs.plane_of(bad)


def test_what_needs_migration(tmp_path):
    old = {"version": 1, "faces": {"a": {"name": "a"}}, "construct": [{"id": "o", "op": "offset", "of": "a", "distance_mm": 1}]}
    assert schema.needs_migrate(old, schema.RECIPE) and not schema.needs_migrate(schema.migrate_recipe(old), schema.RECIPE)
    group = {"group_id": 1, "fit": {"planes": [{"abcd": [1, 0, 0, 2]}]}}
    assert schema.needs_migrate(group, schema.GROUP) and not schema.needs_migrate(schema.migrate_group(group), schema.GROUP)
    (tmp_path / "groups").mkdir()
    path = tmp_path / "groups" / "group_001.json"
    path.write_text(json.dumps(group))
    assert main(["migrate", str(tmp_path), "--dry-run"]) == 0 and json.loads(path.read_text()) == group
    assert main(["migrate", str(tmp_path)]) == 0 and json.loads(path.read_text()) == schema.migrate_group(group)
    assert schema.migrate_project(tmp_path) == []


def test_command_line(spark, folder, tmp_path, capsys):
    P.write_recipe(str(tmp_path / "r.json"), RECIPE)
    assert main(["version"]) == 0 and capsys.readouterr().out.strip() == __version__
    assert main(["reduce", folder, "--recipe", str(tmp_path / "r.json"), "-o", str(tmp_path / "out.json")]) == 0
    out = json.loads((tmp_path / "out.json").read_text())
    assert out["points"]["corner"]["xyz"] == pytest.approx([-50, -20, 100]) and out["lines"]["axis"]["diameter_mm"] == 31.0
    assert out["measures"][0]["value"] == pytest.approx((51**2 + 22**2) ** 0.5) and (tmp_path / "out_summary.json").exists()
    P.write_recipe(str(tmp_path / "bad.json"), {**RECIPE, "faces": {"x": {"name": "nobody"}}, "construct": [], "measures": []})
    assert main(["reduce", folder, "--recipe", str(tmp_path / "bad.json"), "-o", str(tmp_path / "bad_out.json")]) == 1 and not (tmp_path / "bad_out.json").exists()
