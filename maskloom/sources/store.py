"""Files of a store, listed, opened and moved inside tasks.

Names are taken as they stand. `file:` and local paths, and what pyarrow opens by itself (s3, gs, hdfs with
libhdfs, ...) work as they are; for other schemes, put a function into `OPENERS`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyarrow import fs as pf

#: Scheme -> function of the authority ("bucket", "host:port") that gives a file system and the path its root has there.
OPENERS: dict[str, Callable[[str], tuple[pf.FileSystem, str]]] = {}
_OPEN: dict[tuple[str, str], tuple[pf.FileSystem, str]] = {}
_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(.*)", re.S)


def store_of(url: str) -> tuple[pf.FileSystem, str]:
    """The file system of a URL, and its path there."""
    found = _URL.fullmatch(url)
    scheme, authority, path = found.groups() if found else ("file", None, url)
    if scheme == "file":
        return pf.LocalFileSystem(), "/" + path.lstrip("/") if found else path
    key = scheme, authority or ""
    if key not in _OPEN:
        known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        try:
            _OPEN[key] = OPENERS[scheme](key[1]) if scheme in OPENERS else pf.FileSystem.from_uri(f"{known}://{key[1]}/")
        except (OSError, ValueError, NotImplementedError) as error:
            raise OSError(f"tasks can't open {scheme}://{key[1]} by pyarrow: {error}") from error
    store, root = _OPEN[key]
    return store, f"{root.rstrip('/')}/{path.lstrip('/')}"


class Entry(NamedTuple):
    """What stands at a URL: kind is "file", "folder", "other" or "none"; time in nanoseconds."""

    url: str
    kind: str
    size: int
    time: int


_KINDS = {pf.FileType.File: "file", pf.FileType.Directory: "folder", pf.FileType.NotFound: "none"}


def _entry(url: str, info: pf.FileInfo) -> Entry:
    return Entry(url, _KINDS.get(info.type, "other"), info.size or 0, info.mtime_ns or 0)


def look(url: str) -> Entry:
    store, path = store_of(url)
    return _entry(url, store.get_file_info(path))


def children(url: str) -> list[Entry]:
    """What stands right in a folder, hidden names included; nothing when there is no folder."""
    store, path = store_of(url)
    found = store.get_file_info(pf.FileSelector(path, allow_not_found=True))
    return [_entry(f"{url.rstrip('/')}/{info.base_name}", info) for info in found]


def move(source: str, target: str) -> None:
    store, path = store_of(source)
    store.move(path, store_of(target)[1])


def make_folder(url: str) -> None:
    store, path = store_of(url)
    store.create_dir(path, recursive=True)


def remove(url: str) -> None:
    """Remove a file or a folder with all in it; nothing happens when there is none."""
    store, path = store_of(url)
    kind = store.get_file_info(path).type
    if kind == pf.FileType.Directory:
        store.delete_dir(path)
    elif kind != pf.FileType.NotFound:
        store.delete_file(path)


def make_empty(url: str) -> None:
    store, path = store_of(url)
    store.open_output_stream(path).close()
