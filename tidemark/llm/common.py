"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import file_store, fresh_path, scratch, shared_dir, stored

__all__ = ["file_store", "fresh_path", "hash_sample", "map_slices", "scratch", "shared_dir", "stored", "table", "text_column"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_sample(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """At most n rows, those with the least hashes of some columns.

    A filter on the hash first keeps about 2 n rows of all, so that the sort of
    the rest stays small however many partitions there are.
    """
    total, key = df.count(), F.xxhash64(*by)
    if total > 4 * n:
        df = df.where(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * (2 * n / total)))
        key = F.pmod(key, F.lit(1 << 40))
    return df.orderBy(key, *by).limit(n)


def map_slices(
    df: DataFrame, work: Callable[[], Callable | tuple[Callable, Callable]], schema: str, rows: int = 256, chars: int = 4_000_000
) -> DataFrame:
    """mapInArrow in slices of bounded size, so that memory follows the slice and not the Arrow batch.

    work() runs once in each task and returns the function of a slice, or that
    and a function for a last batch when the task has seen all. A slice has at most `rows` rows and, if a column `text` is there, stops after about `chars` bytes of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        each, last = each if isinstance(each, tuple) else (each, None)
        for batch in batches:
            at = 0
            sizes = None
            if "text" in batch.schema.names:
                sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
            while at < batch.num_rows:
                n = min(rows, batch.num_rows - at)
                if sizes is not None:
                    done = sizes[at - 1] if at else 0
                    n = max(1, min(n, int(sizes.searchsorted(done + chars, "right")) - at))
                out = each(batch.slice(at, n))
                at += n
                if out is not None and out.num_rows:
                    yield out
        if last is not None:
            yield last()

    return df.mapInArrow(run, schema)
