"""Shared scratch tables of the operators here, see ``facetspark.scratch``; and names for columns of their own."""

from collections.abc import Iterable

from ..scratch import materialize, scratch_path, shared_dir


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column is called so in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["free_name", "materialize", "scratch_path", "shared_dir"]
