"""Files that tasks read and write themselves."""

from __future__ import annotations

import pyarrow.fs


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system (local, HDFS, S3, GCS) of a path and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)
