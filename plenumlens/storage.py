"""Files of a store as Python tasks see them: local folders and whatever pyarrow has a file system for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path within it, and what goes before such a path to name a file of it."""
    local = re.match(r"file:/*(?=/)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), path[local.end():] if local else path, "file://"
    try:
        store, inner = fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as error:
        raise ValueError(f"{path} is in a store that only Spark's own readers and writers reach") from error
    return store, inner, path[:path.index("://") + 3]


def files_below(path: str, glob: str = "*", recursive: bool = True) -> Iterator[tuple[str, int]]:
    """Paths and sizes of files in path order; names with a leading dot or underscore, and folders of such names, are not data."""
    store, inner, _ = store_of(path)
    found = store.get_file_info(inner)
    if found.type == fs.FileType.File:
        yield found.path, found.size
        return
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inner = inner.rstrip("/")
    for info in sorted(store.get_file_info(fs.FileSelector(inner, recursive=recursive)), key=lambda i: i.path):
        below = info.path[len(inner):].strip("/").split("/")
        if info.type == fs.FileType.File and fnmatch(info.base_name, glob) and not any(p[0] in "._" for p in below):
            yield info.path, info.size
