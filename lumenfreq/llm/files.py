"""Binary files in the shared folder, from executors.  A file appears under its name only when it is complete."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@contextlib.contextmanager
def create(path: str) -> Iterator[pafs.NativeFile]:
    """Opens a file for writing.  Whoever is first or last to finish (a task may run twice) leaves a whole file."""
    fs, p = filesystem(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    part = f"{p}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, buffer_size=1 << 20) as out:
        yield out
    fs.move(part, p)


def open_input(path: str):
    fs, p = filesystem(path)
    return fs.open_input_file(p)
