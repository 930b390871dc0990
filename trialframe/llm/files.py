"""Files in the shared folder, from executors: written whole, read by sorted and coalesced byte ranges."""

from __future__ import annotations

from collections.abc import Iterable

#: Ranges closer than this are read at once, up to so many bytes.
GAP, MOST = 32 << 10, 8 << 20


def filesystem(path: str):
    """pyarrow's file system and the path in it; local paths may come as ``file:/x``."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def create(path: str):
    """An output stream; the folder is made where the store has folders."""
    system, inner = filesystem(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)  # a name in .gz would add a layer


def coalesced(ranges: Iterable[tuple[str, int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[str, int, int]]:
    """(file, offset, length) sorted, with near ones of a file joined."""
    out: list[list] = []
    for path, at, n in sorted(set(ranges)):
        if out and out[-1][0] == path and at - (out[-1][1] + out[-1][2]) <= gap and at + n - out[-1][1] <= most:
            out[-1][2] = max(out[-1][2], at + n - out[-1][1])
        else:
            out.append([path, at, n])
    return [tuple(x) for x in out]


def fetched(ranges: list[tuple[str, int, int]]) -> dict[tuple[str, int, int], bytes]:
    """The bytes of each range, by coalesced reads; each file is opened once."""
    want = sorted(set(ranges))
    out, at, handle, name = {}, 0, None, None
    for path, lo, n in coalesced(want):
        if path != name:
            if handle:
                handle.close()
            system, inner = filesystem(path)
            handle, name = system.open_input_file(inner), path
        data = handle.read_at(n, lo)
        while at < len(want) and want[at][0] == path and lo <= want[at][1] and want[at][1] + want[at][2] <= lo + n:
            out[want[at]] = data[want[at][1] - lo : want[at][1] - lo + want[at][2]]
            at += 1
    if handle:
        handle.close()
    return out


def swept(folder: str, keep: set[str]) -> None:
    """Removes files of attempts that were not committed."""
    from pyarrow import fs

    system, inner = filesystem(folder)
    for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if f.is_file and f.base_name not in keep:
            system.delete_file(f.path)
