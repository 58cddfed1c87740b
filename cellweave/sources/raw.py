"""Files by path or URI, decompressed by their first bytes."""

from __future__ import annotations

import bz2
import gzip
import io
import os
from collections.abc import Iterator

from pyarrow import fs

#: First bytes of compressed files.
GZIP, BZIP2 = b"\x1f\x8b", b"BZh"


def located(path: str) -> tuple[fs.FileSystem, str]:
    path = path.removeprefix("file:") if path.startswith("file:") and "://" not in path else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def expanded(paths: list[str]) -> list[str]:
    """Files of the paths: those of folders in the order of their names. A missing path is an error."""
    out = []
    for path in paths:
        system, inner = located(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.Directory:
            names = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and not f.base_name.endswith(".index"))
            prefix = path[: path.index("://") + 3] if "://" in path else ""
            out += [prefix + n for n in names]
        else:
            out.append(path)
    return out


def opened(path: str) -> io.BufferedIOBase:
    """A stream of the plain bytes."""
    system, inner = located(path)
    stream = io.BufferedReader(system.open_input_file(inner), 1 << 20)
    first = stream.peek(3)[:3]
    if first.startswith(GZIP):
        return gzip.GzipFile(fileobj=stream)
    return bz2.BZ2File(stream) if first == BZIP2 else stream


def total_size(paths: list[str]) -> int:
    """Bytes on disk."""
    return sum(located(p)[0].get_file_info(located(p)[1]).size for p in expanded(paths))


def lines(path: str, comment: str | None = None) -> Iterator[tuple[int, str]]:
    """Number (from 0, after the leading run of comments) and text of each line."""
    leading, rec = comment is not None, 0
    with opened(path) as stream:
        for raw in io.TextIOWrapper(stream, "utf-8", errors="surrogateescape", newline="\n"):
            line = raw.removesuffix("\n").removesuffix("\r")
            if leading and line.startswith(comment):
                continue
            leading = False
            yield rec, line
            rec += 1
