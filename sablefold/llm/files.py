"""Raw files in the shared folder, written and read by executors through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, parts) -> str:
    """Write byte strings as one file. It appears under its name only when complete, so tasks that
    are lost, repeated or run twice leave one whole file."""
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as f:
        for part in parts:
            f.write(part)
    system.move(draft, f"{path}/{name}")
    return f"{path}/{name}"


def stream(uri: str, name: str):
    system, path = open_folder(uri)
    return system.open_input_stream(f"{path}/{name}", compression=None)


def random_access(uri: str, name: str):
    system, path = open_folder(uri)
    return system.open_input_file(f"{path}/{name}")
