"""Command line: reduce, migrate, version."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("facetspark")
    sub = parser.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reduce", help="run a recipe over a project")
    r.add_argument("project")
    r.add_argument("--recipe", required=True)
    r.add_argument("-o", "--output", default="geometry.json")
    m = sub.add_parser("migrate", help="bring documents to the current version")
    m.add_argument("project")
    m.add_argument("--recipe")
    m.add_argument("--geometry")
    m.add_argument("--dry-run", action="store_true")
    sub.add_parser("version")
    a = parser.parse_args(argv)
    try:
        if a.command == "version":
            print(__version__)
        elif a.command == "migrate":
            from .plans.schema import migrate_project

            for path in migrate_project(a.project, a.recipe, a.geometry, a.dry_run):
                print(path)
        else:
            from .plans.recipe import Recipe, geometry_summary, reduce_survey
            from .plans.schema import write_json
            from .session import local_session
            from .sources.project import bind_faces, face_diameters

            raw = json.loads(Path(a.recipe).read_text())
            doc = Recipe.of(raw).doc
            faces = bind_faces(a.project, doc)
            geometry = reduce_survey(local_session("2"), raw, faces, str(Path(a.project).resolve()), face_diameters(a.project, doc))
            out = Path(a.output)
            write_json(out, geometry)
            write_json(out.with_name(f"{out.stem}_summary.json"), geometry_summary(geometry))
    except (ValueError, KeyError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
