"""Files by their paths, opened where they are needed instead of carried through Spark."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
