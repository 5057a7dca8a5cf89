"""Folders in shared storage for what an operator writes on the way.

They lie below ``spark.checkpoint.dir``, which the driver and all executors reach; a temporary folder is used only
where that setting is absent and Spark runs in one process, as in tests.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

_SCRATCH: list[list[str]] = []


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator; removed when the driver ends, or with the ``scratch`` around it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    # a path without a scheme lies in Spark's default file system
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, local = filesystem(path)
    fs.create_dir(local, recursive=True)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    else:
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    fs, local = filesystem(path)
    try:
        fs.delete_dir(local)
    except OSError:
        pass


@contextmanager
def scratch() -> Iterator[None]:
    """What operators store inside goes at its end: for callers that have written the result somewhere else by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _remove(path)
