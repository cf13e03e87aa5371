"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def create(folder: str, suffix: str) -> tuple[str, BinaryIO]:
    """A new file of a name that no other attempt uses; (name, stream).

    Only what a task returns counts, so the files of lost or repeated attempts are never read.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return name, system.open_output_stream(f"{path}/{name}", compression=None)


def open_stream(folder: str, name: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(folder)
    return system.open_input_stream(f"{path}/{name}", compression=None)


def open_file(folder: str, name: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(folder)
    return system.open_input_file(f"{path}/{name}")
