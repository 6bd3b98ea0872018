"""Projects on disk: settings, manifest, group documents, and the points and inliers of groups as tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.numbering import numbered
from ..operators.planes import Plane
from ..plans.codecs import plane_of, round_of
from ..plans.schema import migrate_group, write_json

# What a fit entry keeps on disk.
FIT_KEYS = {
    "planes": ("plane_index", "normal", "d", "n_points", "status", "reasons", "bimodal", "mad_sigma_mm", "threshold_mm", "source_plane_index", "n_selected", "name", "inlier_n"),
    "cylinders": ("cylinder_index", "point", "direction", "diameter_mm", "diameter_fixed", "n_points", "status", "reasons", "mad_sigma_mm", "threshold_mm", "name", "inlier_n"),
    "circles": ("circle_index", "center", "normal", "diameter_mm", "diameter_fixed", "n_points", "status", "reasons", "mad_sigma_mm", "threshold_mm", "name", "support_plane_index", "n_selected", "inlier_n"),
}


@dataclass(frozen=True)
class Settings:
    version: int = 1
    units: str = "mm"
    display_voxel_mm: float = 1.0
    display_max_points: int = 4_000_000
    ransac_backend: str = "seeded"


def load_settings(project: str) -> tuple[Settings, list[str]]:
    """Settings with defaults for what is missing, and the names of unknown keys, which are ignored."""
    path = Path(project, "settings.json")
    doc = json.loads(path.read_text()) if path.exists() else {}
    if doc.get("ransac_backend") == "numpy":
        doc["ransac_backend"] = "seeded"
    known = {k: v for k, v in doc.items() if k in Settings.__dataclass_fields__}
    return Settings(**known), sorted(set(doc) - set(known) - {"compute_backend"})


def save_settings(project: str, settings: Settings) -> None:
    write_json(Path(project, "settings.json"), asdict(settings))


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def save_manifest(project: str, source: str, n_points: int) -> None:
    write_json(Path(project, "manifest.json"), {"version": 1, "units": "mm", "source": source, "num_points": n_points, "created_utc": datetime.now(UTC).isoformat()})


def load_manifest(project: str) -> dict:
    path = Path(project, "manifest.json")
    return json.loads(path.read_text()) if path.exists() else {}


def save_group(project: str, doc: dict, points: DataFrame | None = None, inliers: DataFrame | None = None) -> None:
    """A group document, its points (point_id, x, y, z) and its inliers (entity, point_id) as Parquet beside it."""
    gid = int(doc["group_id"])
    fit = {k: [{n: e[n] for n in names if n in e} for e in map(_plane_keys, (doc.get("fit") or {}).get(k) or []) if isinstance(e, dict)] for k, names in FIT_KEYS.items()}
    out = {"version": 1, "units": "mm", **doc, "fit": fit if doc.get("fit") else None, "created_utc": datetime.now(UTC).isoformat()}
    root = Path(project, "groups")
    if points is not None:
        points.select("point_id", "x", "y", "z").write.mode("overwrite").parquet(str(root / f"points_{gid:03d}"))
    if inliers is not None:
        known = points.select("point_id") if points is not None else None
        if known is not None and not inliers.join(known, "point_id", "left_anti").isEmpty():
            raise ValueError("inliers that are not points of the group")
        inliers.select("entity", "point_id").write.mode("overwrite").partitionBy("entity").parquet(str(root / f"inliers_{gid:03d}"))
    write_json(root / f"group_{gid:03d}.json", out)


def _plane_keys(entry: dict) -> dict:
    if "abcd" in entry:
        plane = Plane.from_array(entry["abcd"])
        return {**{k: v for k, v in entry.items() if k != "abcd"}, "normal": list(plane.normal), "d": plane.d}
    return entry


def load_groups(project: str) -> list[dict]:
    """Group documents by id, old ones read as new."""
    root = Path(project)
    folder = root / "groups" if (root / "groups").is_dir() else root
    docs = [migrate_group(json.loads(p.read_text())) for p in sorted(folder.glob("group_*.json"))]
    return sorted(docs, key=lambda d: d["group_id"])


def load_points(spark: SparkSession, project: str, group_id: int) -> DataFrame:
    return spark.read.parquet(str(Path(project, "groups", f"points_{group_id:03d}")))


def load_inliers(spark: SparkSession, project: str, group_id: int) -> DataFrame | None:
    """(entity, point_id, local_idx): places among the group's points in id order, or None if none were saved."""
    path = Path(project, "groups", f"inliers_{group_id:03d}")
    if not path.exists():
        return None
    ranked = numbered(load_points(spark, project, group_id).select("point_id"), ["point_id"], "local_idx")
    return spark.read.parquet(str(path)).join(ranked, "point_id")


def find_group(docs: list[dict], name: str | None = None, group_id: int | None = None) -> dict:
    hits = [d for d in docs if (d.get("name") == name if name is not None else d["group_id"] == group_id)]
    if len(hits) != 1:
        raise KeyError(f"{len(hits)} groups are called {name if name is not None else group_id!r}; one is needed")
    return hits[0]


#: alias and spec of a face to (kind, numbers), or None to look in the project.
Binder = Callable[[str, dict], tuple[str, list[float]] | None]


def _fit_entry(docs: list[dict], alias: str, spec: dict) -> tuple[str, dict]:
    """The list that a face's fit is in, and its entry."""
    doc = find_group(docs, spec.get("name"), spec.get("group_id"))
    key = {"cylinder": "cylinders", "circle": "circles"}.get(str(spec.get("kind", "plane")).lower(), "planes")
    index_key = f"{key[:-1]}_index"
    entries = [e for e in (doc.get("fit") or {}).get(key) or [] if int(e.get(index_key, 0)) == int(spec.get(index_key, 0))]
    if len(entries) != 1:
        raise KeyError(f"faces.{alias}: no single fit of that index")
    return key, entries[0]


def bind_faces(project: str | None, recipe: dict, bind_face: Binder | None = None) -> dict[str, tuple[str, list[float]]]:
    """The numbers of each face of a recipe: plane n and d, cylinder axis, circle center.

    ``bind_face`` may give a face itself, for one that is not in the project or to
    override what is there; where it gives None the project's groups are asked.
    """
    if project is None and bind_face is None:
        raise ValueError("faces need a project or a binder")
    if project is not None and not Path(project).is_dir():
        raise NotADirectoryError(f"not a directory: {project}")
    docs, out = load_groups(project) if project is not None else None, {}
    for alias, spec in recipe["faces"].items():
        own = bind_face(alias, spec) if bind_face is not None else None
        if own is not None:
            out[alias] = own
            continue
        if docs is None:
            raise ValueError(f"faces.{alias}: the binder gives nothing and there is no project")
        key, e = _fit_entry(docs, alias, spec)
        if key == "planes":
            plane = plane_of(e)
            out[alias] = ("plane", [*plane.normal, plane.d])
        elif key == "cylinders":
            item = round_of("cylinder", e)
            out[alias] = ("line", [*item.at, *item.along])
        else:
            out[alias] = ("point", list(round_of("circle", e).at))
    return out


def face_diameters(project: str, recipe: dict) -> dict[str, dict]:
    """diameter_mm and diameter_fixed of the round faces: a recipe's own diameter wins over the fit's, and is fixed unless it says no."""
    docs, out = load_groups(project), {}
    for alias, spec in recipe["faces"].items():
        kind = str(spec.get("kind", "plane")).lower()
        if kind not in ("cylinder", "circle"):
            continue
        item = round_of(kind, _fit_entry(docs, alias, spec)[1])
        if "diameter_mm" in spec:
            item = replace(item, diameter_mm=float(spec["diameter_mm"]), diameter_fixed=bool(spec.get("diameter_fixed", True)))
        out[alias] = {"diameter_mm": item.diameter_mm, "diameter_fixed": item.diameter_fixed}
    return out


def write_recipe(path: str, recipe: dict) -> None:
    write_json(Path(path), recipe)
