"""Files by path or URI through pyarrow's file systems, for readers that want parts of a file."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyarrow import fs

#: Files of a task at most, whatever their sizes: opening a small file takes longer than reading it.
FILES_EACH = 1024
#: Threads for what the driver does file by file (pyarrow waits without Python's lock).
THREADS = 16
T, U = TypeVar("T"), TypeVar("U")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def below(where: fs.FileSystem, path: str, extension: str) -> list[fs.FileInfo]:
    """The files with an extension (any case), sorted, without hidden ones and those in hidden or staging folders."""
    info = where.get_file_info(path)
    found = where.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
    hidden = lambda f: any(p[:1] in "._" for p in f.path.removeprefix(path).strip("/").split("/") if p)
    return sorted((f for f in found if f.is_file and f.extension.lower() == extension and not hidden(f)), key=lambda f: f.path)


def dealt(ranges: Iterable[tuple[T, int]], split: int) -> list[list[T]]:
    """Ranges, given with their bytes, as the lists that tasks read: up to `split` bytes and FILES_EACH files each."""
    out, room = [], 0
    for found, size in ranges:
        size += split // FILES_EACH
        if not out or size > room or len(out[-1]) >= FILES_EACH:
            out.append([])
            room = split
        out[-1].append(found)
        room -= size
    return out


def in_threads(f: Callable[[T], U], items: list[T], block: int = 256) -> list[U]:
    """f of each, in blocks of items."""
    blocks = [items[k : k + block] for k in range(0, len(items), block)]
    with ThreadPoolExecutor(THREADS) as pool:
        return [x for done in pool.map(lambda part: [f(x) for x in part], blocks) for x in done]
