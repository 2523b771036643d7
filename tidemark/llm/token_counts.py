"""Token counts through a digest cache.

The cache is a lasting table of (content digest, tokenizer digest, count).
Documents are reduced to the digest of their normalised content (null as empty,
UTF-8) and joined with the stored counts of this very tokenizer version; only
contents without a stored count are encoded, each once, and appended.

Digests cross the shuffle, texts do not. Of the partitions that hold a missing
content one is its owner; the digests that a partition owns go to a file of
their own, and each task encodes, where they lie, the texts that its file
names. Should the partitions be dealt otherwise when they are read again, what
was not met is encoded after a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_store, fresh_path, map_slices, shared_dir, stored, table, text_column
from .tokens import encoder

CACHE = "content binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an empty table is written where there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _encoded(keys: list[bytes], texts: list[str], tokenizer: str, version: str) -> pa.RecordBatch:
    counts = encoder(tokenizer).counts(texts) if texts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([version] * len(keys), pa.string()), pa.array(counts, pa.int64())], ["content", "tokenizer", "n_tokens"])


def encode_owned(docs: DataFrame, owners: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """content, tokenizer, n_tokens of the contents in owners (content, part) that lie in that partition of docs."""
    folder = fresh_path(docs.sparkSession, "token-owners")
    owners.repartition("part").write.partitionBy("part").parquet(folder)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        store, path = file_store(f"{folder}/part={TaskContext.get().partitionId()}")
        files = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
        # The digests of one partition's texts: 32 bytes each.
        left = {key for f in files for key in pq.read_table(f, filesystem=store, columns=["content"], partitioning=None)["content"].to_pylist()}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, texts = [], []
            for text in batch.column("text").to_pylist() if left else []:
                key = hashlib.sha256(text.encode()).digest()
                if key in left:
                    left.remove(key)
                    keys.append(key)
                    texts.append(text)
            return _encoded(keys, texts, tokenizer, version) if keys else None

        return each

    return map_slices(docs.select(text_column().alias("text")), work, CACHE)


def encode_misses(docs: DataFrame, misses: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """content, tokenizer, n_tokens of each content in misses, wherever it lies: their texts are shuffled."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        return lambda batch: _encoded(batch.column("content").to_pylist(), batch.column("text").to_pylist(), tokenizer, version)

    texts = docs.select(digest(text_column()).alias("content"), text_column().alias("text")).join(misses.select("content"), "content", "left_semi")
    return map_slices(texts.groupBy("content").agg(F.first("text").alias("text")), work, CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; new counts are appended to `cache`.

    Null text counts as empty, very long texts are counted whole; repeated
    rows and null doc_id are kept; an empty table gives no rows.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    known = lambda: read_cache(spark, cache).where(F.col("tokenizer") == version)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_column()).alias("content"), F.octet_length(text_column()).cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"))
    rows = stored(rows, "token-digests")
    contents = rows.groupBy("content").agg(F.min("part").alias("part"))
    for encode in (encode_owned, encode_misses):
        misses = stored(contents.join(known().select("content"), "content", "left_anti"), "token-misses")
        if misses.isEmpty():
            break
        encode(docs, misses, tokenizer, version).write.mode("append").parquet(cache)
    # Of the counts only those of these documents; one may be there twice if two runs met the same text at once.
    counts = known().join(contents.select("content"), "content", "left_semi").groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    counts = stored(counts, "token-counts-once")  # so that both sides of the join are plain exchanges and a hot content can be split
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of a corpus lies in the shared folder, named by a digest of the tables' address: a second run meets the counts of the first."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-counts-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
