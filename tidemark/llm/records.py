"""Length-delimited binary records of token ids, with a separate offset index for shuffled reads.

A file holds the records of one range of doc_id, ascending. One record:

    8 bytes  length n of the payload
    4 bytes  masked checksum of those 8 bytes
    n bytes  payload
    4 bytes  masked checksum of the payload

all little-endian. The checksum is CRC-32, masked as
((c >> 15 | c << 17) + 0xa282ead8) mod 2^32, so that records whose payload
holds checksums stay safe. A payload is one serialized sequence: doc_id
(8 bytes, signed; the least value for null), the width of an id (1 byte, 2 or
4) and the ids. The index is a table of doc_id, file, shard, offset, size and n_tokens;
a reader takes any rows of it in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import file_store, fresh_path, table, text_column
from .tokens import encoder, id_type

NO_ID = -(1 << 63)
HEAD = struct.Struct("<QI")
INDEX = "doc_id long, file string, shard int, offset long, size long, n_tokens long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(take: callable) -> bytes | None:
    """The next payload by take(n bytes); None at the end. Raises ValueError if a checksum differs."""
    head = take(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise ValueError("the length of a record is damaged")
    n = HEAD.unpack(head)[0]
    body = take(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("the payload of a record is damaged")
    return body[:n]


def _payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<qB", NO_ID if doc_id is None else doc_id, ids.itemsize) + ids.tobytes()


def _parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encode whole texts, write the record files and the index under `folder`; the index.

    Null text counts as empty; very long texts are encoded whole. Rows with
    equal or null doc_id are all kept (nulls first), ordered by a hash of the
    text. An empty table gives an empty index. A task that runs again
    writes a new file; only the file of the run that Spark commits is in the index.
    """
    kind = id_type(tokenizer)
    data = f"{folder}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, path = file_store(data)
        store.create_dir(path, recursive=True)
        name = f"{path}/{shard:06d}-{uuid.uuid4().hex}.rec"
        out, at = None, 0
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                out = out or store.open_output_stream(name)
                ids, length = encoder(tokenizer).encode(batch.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(length), end_id).astype(kind)
                length = (length + 1).tolist()
                offsets, sizes, first = [], [], 0
                frames = []
                for doc_id, n in zip(batch.column("doc_id").to_pylist(), length, strict=True):
                    frames.append(frame(_payload(doc_id, ids[first : first + n])))
                    first += n
                    offsets.append(at)
                    sizes.append(len(frames[-1]))
                    at += sizes[-1]
                out.write(b"".join(frames))
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([name.rpartition("/")[2]] * rows), pa.array([shard] * rows, pa.int32()), *(pa.array(x, pa.int64()) for x in (offsets, sizes, length))],
                    ["doc_id", "file", "shard", "offset", "size", "n_tokens"],
                )
        if out is not None:
            out.close()

    # Equal ids are ordered, and dealt out, by a hash of the text and then the text, so that a hot id is no hot task and the order is always the same.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).withColumn("h", F.xxhash64("text"))
    rows = (rows.repartitionByRange(partitions, "doc_id", "h") if partitions else rows.repartitionByRange("doc_id", "h")).sortWithinPartitions("doc_id", "h", "text")
    rows.mapInArrow(write, INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return read_index(docs.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every indexed file, read from its start to its end: shard, doc_id, ids (bytes of unsigned 32-bit), start, n_tokens.

    start counts the ids of all records before it.
    """
    index = read_index(spark, folder)
    shards = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("tokens"))
    n_files = max(1, index.select("shard", "file").distinct().count())
    # One row for each file, so its window in one task has as many rows as there are files: one in hundreds of MB of text.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    data = f"{folder}/data"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_store(data)
        for batch in batches:
            for shard, file, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "file", "base")), strict=True):
                with store.open_input_stream(f"{path}/{file}") as f:
                    rows: list[tuple] = []
                    at, held = base, 0

                    def done(rows: list[tuple], shard: int = shard) -> pa.RecordBatch:
                        ids, raw, start, n = zip(*rows, strict=True)
                        return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], ["shard", "doc_id", "ids", "start", "n_tokens"])

                    while (payload := unframe(f.read)) is not None:
                        doc_id, ids = _parse(payload)
                        rows.append((doc_id, ids.tobytes(), at, len(ids)))
                        at += len(ids)
                        held += len(payload)
                        if held > 4_000_000:
                            yield done(rows)
                            rows, held = [], 0
                    if rows:
                        yield done(rows)

    # A stated number, as adaptive execution would join so few rows into one task that reads all files.
    return shards.repartition(n_files, "shard", "file").mapInArrow(read, "shard int, doc_id long, ids binary, start long, n_tokens long")


def read_rows(index_rows: DataFrame, folder: str) -> DataFrame:
    """The records of chosen index rows, in any order (a shuffled read): doc_id, ids."""
    data = f"{folder}/data"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_store(data)
        opened: dict[str, object] = {}
        for batch in batches:
            out = []
            for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                if file not in opened:
                    while len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[file] = store.open_input_file(f"{path}/{file}")
                whole = memoryview(opened[file].read_at(size, offset))
                at = 0

                def take(n: int, whole: memoryview = whole) -> bytes:
                    nonlocal at
                    at += n
                    return bytes(whole[at - n : at])

                doc_id, ids = _parse(unframe(take))
                out.append((doc_id, ids.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.binary())], ["doc_id", "ids"])
        for f in opened.values():
            with suppress(OSError):
                f.close()

    return index_rows.select("file", "offset", "size").mapInArrow(read, "doc_id long, ids binary")


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
