"""The shared folder, tables written there to cut lineage, and files that tasks write themselves."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from .. import storage
from ..storage import forget, new_folder, shared_dir

__all__ = ["forget", "new_folder", "shared_dir"]

#: Bytes of texts that a worker takes in at once, in place of Spark's default of 64 MB; a session's own setting stays.
BATCH, DEFAULT, SETTING = 8 << 20, "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> SparkSession:
    """The session, whose batches of rows for Python workers are small from now on: JVM and worker hold several copies."""
    if spark.conf.get(SETTING, None) == DEFAULT:
        spark.conf.set(SETTING, BATCH)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """As the core's `written`, in small batches."""
    in_small_batches(df.sparkSession)
    return storage.written(df, name)


def once_a_worker(make: Callable[[str], object], path: str) -> object:
    """make(path), kept for the other tasks of a worker process. As this package's functions travel by value (see its
    __init__), a cache in one of its modules would be each task's own, or ask workers to import the package; so it is kept
    under a module of its own name."""
    held = sys.modules.setdefault("_made_once_in_this_worker", ModuleType("_made_once_in_this_worker")).__dict__
    key = f"{make.__qualname__}:{path}"
    if key not in held:
        held[key] = make(path)
    return held[key]


def file_system(uri: str):
    """(a pyarrow file system, the path in it) of a local or remote uri."""
    from pyarrow import fs

    if not urlparse(uri).scheme or uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, after which the worker, that other tasks will use, gives free memory back to the system:
    Arrow and the C library keep what large batches of texts took."""

    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied
