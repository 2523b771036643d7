"""Small tables that jobs change: versions in a shared folder, of which readers see the newest whole one.

A version is a folder of data and a marker that names it. The marker is made
last and only if there is none of its number yet: a write that fails leaves the
version before it, and of two writers that began from one version the second
gets an error and can begin again. Files go through Hadoop's file systems, so a folder may be in any store that Spark writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_registry, read_sessions


class Conflict(RuntimeError):
    """Another writer has made the version meanwhile."""


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Addresses that match a pattern, in order."""
    store, path = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in store.globStatus(path) or [])


def versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The data folder of each whole version; a marker without content is of a writer that was cut off."""
    out = {}
    for marker in found(spark, f"{folder}/_versions/*"):
        store, path = _path(spark, marker)
        stream = store.open(path)
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        if name:
            out[int(marker.rsplit("/", 1)[1])] = f"{folder}/{name}"
    return out


def _last_number(spark: SparkSession, folder: str) -> int:
    markers = found(spark, f"{folder}/_versions/*")
    return int(markers[-1].rsplit("/", 1)[1]) if markers else 0


def commit(spark: SparkSession, folder: str, write: Callable[[str], None], after: int | None = None) -> int:
    """Lets write(path) put the data of the next version into a new folder, then makes it the newest; data of a write that fails are deleted. after= is the number that must still be the last."""
    number = (_last_number(spark, folder) if after is None else after) + 1
    name = f"data-{number}-{uuid.uuid4().hex}"
    try:
        write(f"{folder}/{name}")
        store, marker = _path(spark, f"{folder}/_versions/{number:020d}")
        if store.exists(marker):
            raise Conflict(f"version {number} of {folder} is there already")
        out = store.create(marker, False)  # raises if another writer was faster
    except Exception:
        store, data = _path(spark, f"{folder}/{name}")
        store.delete(data, True)
        raise
    out.write(bytearray(name.encode()))
    out.close()
    return number


def newest(spark: SparkSession, folder: str) -> str | None:
    there = versions(spark, folder)
    return there[max(there)] if there else None


def forget(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Deletes the data of all but the last versions; their markers stay, so that numbers are not used again."""
    there = versions(spark, folder)
    for number in sorted(there)[:-keep]:
        store, path = _path(spark, there[number])
        store.delete(path, True)


def save_registry(rows: DataFrame, folder: str, after: int | None = None) -> int:
    """The registry (A5) as JSON rows; returns the version's number."""
    return commit(rows.sparkSession, folder, lambda path: rows.write.json(path), after)


def load_registry(spark: SparkSession, folder: str) -> DataFrame:
    path = newest(spark, folder)
    if path is None:
        raise FileNotFoundError(f"no registry in {folder}")
    return read_registry(spark, path, multi_line=False)


def change_registry(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Makes the next version from the newest, and again from the one then newest if another writer came between."""
    for left in reversed(range(tries)):
        last = _last_number(spark, folder)
        try:
            return save_registry(change(load_registry(spark, folder)), folder, last)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")


def save_sessions(rows: DataFrame, folder: str, blocks: int = 64, after: int | None = None) -> int:
    """Sessions (A5: device_id and its fields) as JSON objects keyed by device, each a line with the devices of one of `blocks` hash blocks."""
    fields = F.struct(*(c for c in rows.columns if c != "device_id"))
    entries = rows.select(F.pmod(F.xxhash64("device_id"), F.lit(blocks)).alias("block"), F.struct("device_id", fields.alias("s")).alias("e"))
    lines = entries.groupBy("block").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).select("value")
    return commit(rows.sparkSession, folder, lambda path: lines.write.text(path), after)


def load_sessions(spark: SparkSession, folder: str) -> DataFrame:
    path = newest(spark, folder)
    if path is None:
        raise FileNotFoundError(f"no sessions in {folder}")
    return read_sessions(spark, path, whole=False)
