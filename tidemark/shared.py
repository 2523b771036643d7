"""Tables and files in the folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: The folders of the innermost open scratch block of this thread or task, and the temporary folder of local sessions once there is one.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder, as its one
    machine runs all tasks; on a cluster that raises ValueError, as each
    executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return _local[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = _scratch.get()
    if own is not None:
        own.append(path)
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The same rows from a table written to the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_store(folder: str):  # noqa: ANN201
    """The file system of a folder's address (local, hdfs, s3, ...) and the path on it."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def remove(folder: str) -> None:
    store, path = file_store(folder)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Deletes, when the block ends or the given function is called, what stored() and fresh_path() have put into the shared folder within it, in the same thread."""
    own: list[str] = []
    outer = _scratch.set(own)

    def clear() -> None:
        for folder in own:
            remove(folder)
        own.clear()

    try:
        yield clear
    finally:
        _scratch.reset(outer)
        clear()
