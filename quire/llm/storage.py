"""Files on the shared folder from inside tasks: local paths by the operating system, other stores by pyarrow."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    at = urlparse(uri)
    return unquote(at.path) if at.scheme in ("", "file") else None


def write_file(uri: str, parts) -> int:
    """Write the byte strings of parts to uri, whole or not at all; returns the bytes written."""
    size = 0
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as out:
            for x in parts:
                size += out.write(x)
        os.replace(f"{path}.part", path)
        return size
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(f"{path}.part") as out:
        for x in parts:
            out.write(x)
            size += len(x)
    store.move(f"{path}.part", path)
    return size


def open_file(uri: str):
    """A readable, seekable binary file."""
    if path := _local(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
