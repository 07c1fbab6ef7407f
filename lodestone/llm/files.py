"""Files in the shared folder, by URI: a local or mounted path, or any store that pyarrow's file systems reach."""

from __future__ import annotations

from pyarrow import NativeFile
from pyarrow import fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop writes local URIs as file:/path
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def open_write(uri: str) -> NativeFile:
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def open_read(uri: str) -> NativeFile:
    system, path = _at(uri)
    return system.open_input_stream(path)


def open_seekable(uri: str) -> NativeFile:
    system, path = _at(uri)
    return system.open_input_file(path)
