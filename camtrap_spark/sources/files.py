"""Files by path, in tasks."""

from __future__ import annotations

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; a bare path is a local one. Names may hold any character."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    authority, _, inside = rest.lstrip("/").partition("/")
    there, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return there, f"{root.rstrip('/')}/{inside}"
