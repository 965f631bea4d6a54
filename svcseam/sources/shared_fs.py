"""Files on shared storage from Python tasks, through pyarrow's file systems."""

from __future__ import annotations

import re
import sys

import pyarrow.fs as pafs
from pyspark import cloudpickle


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI (``file:``, ``hdfs:``, ``s3a:``, ...) or a
    plain local path."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:(//[^/]*)?", "", path)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
