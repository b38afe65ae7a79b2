"""Files of any file system that pyarrow knows (local, ``file:``, ``hdfs:``, ``s3:`` ...), for driver and workers alike."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatch

from pyarrow import fs

_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]+:", re.I)


def of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; ``file:/x`` and ``file:///x`` are the same."""
    if not _SCHEME.match(path):
        return fs.LocalFileSystem(), path
    if path.lower().startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path, flags=re.I)
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    system, inner = of(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def size(path: str) -> int:
    system, inner = of(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def listed(pattern: str) -> list[str]:
    """The files whose path matches ``pattern``, sorted; ``*`` and ``?`` may stand in the last part only."""
    system, inner = of(pattern)
    folder, _, name = inner.rpartition("/")
    if not re.search(r"[*?\[]", name):
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [pattern]
        folder, name = inner, "*"
    rows = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    head = pattern[: len(pattern) - len(inner)]
    return sorted(head + r.path for r in rows if r.type == fs.FileType.File and fnmatch(r.path.rpartition("/")[2], name))


@contextmanager
def reader(path: str) -> Iterator[Callable[[int, int], bytes]]:
    """A function that reads the bytes from a start to a stop."""
    system, inner = of(path)
    with system.open_input_file(inner) as file:
        yield lambda start, stop: file.read_at(max(0, stop - start), start)


def write(path: str, data: bytes) -> None:
    """Writes a file under another name first and moves it, so that no reader sees a part of it."""
    system, inner = of(path)
    folder, _, name = inner.rpartition("/")
    if folder:
        system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp" if folder else f".{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, inner)


def claim(path: str, data: bytes) -> bool:
    """Makes a marker file; false if it was there. Of two that come at the same moment, both may be told true."""
    if exists(path):
        return False
    write(path, data)
    return True
