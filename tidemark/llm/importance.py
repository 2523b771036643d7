"""Importance resampling towards a target text set, over hashed runs of words.

The tokenizers library cuts words: an untrained Regex split over texts whose
A-Z are lower-cased gives each word with its offsets. Offsets of the words,
put together with one space between, give windows (start of a run, its end);
the CRC of a window's bytes is its bucket. Counts of the buckets in the corpus
and in the target give each bucket a gain; a document weighs the mean of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import map_slices, stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts go to the library in parts of about so many bytes, cut where no word is, as its cost for each word grows with a text's length.
PART = 1500
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


class WordWindows:
    """windows(text): the bytes of its words, one space between, and start and end of each run of words there."""

    def __init__(self, most: int = 1) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split, self.most = Split(Regex(WORD), "removed", invert=True).pre_tokenize_str, most

    def _found(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        low = text.encode().lower()  # of bytes, so A-Z alone
        found, at = [], 0
        while at < len(low):
            gap = _GAP.search(low, at + PART)
            end = gap.start() if gap else len(low)
            found += self.split(low[at:end].decode())
            at = end
        return found

    def windows(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray, int]:
        found = self._found(text)
        joined = " ".join([w for w, _ in found])
        sizes = np.array([b - a for _, (a, b) in found], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        if not joined.isascii():
            units = np.frombuffer(joined.encode(), np.uint8)
            byte = np.append(np.flatnonzero((units & 0xC0) != 0x80), len(units))
            starts, ends = byte[starts], byte[ends]
        n = len(found)
        first = np.concatenate([starts[: n - k] for k in range(min(self.most, n))] or [starts])
        last = np.concatenate([ends[k:] for k in range(min(self.most, n))] or [ends])
        return joined.encode(), first, last, n


def hashed_features(docs: DataFrame, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features, buckets (of each feature, packed integers) of documents (doc_id, text); features are runs of 1 to `most` words."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def work():  # noqa: ANN202
        cut, crc = WordWindows(most), zlib.crc32

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, counts, packed = [], [], []
            for text in batch.column("text").to_pylist():
                units, first, last, n = cut.windows(text)
                found = np.fromiter((crc(units[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint32, len(first))
                words.append(n)
                counts.append(len(found))
                packed.append((found % buckets).astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_slices(rows, work, "doc_id long, n_words long, n_features long, buckets binary")


def _unpacked(column: pa.Array, buckets: int) -> np.ndarray:
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def histogram(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features in each bucket: a task sends a row for each bucket at most, the driver gets as many."""

    def work():  # noqa: ANN202
        total = np.zeros(buckets, np.int64)

        def each(batch: pa.RecordBatch) -> None:
            np.add(total, np.bincount(_unpacked(batch.column("buckets"), buckets), minlength=buckets), out=total)

        def last() -> pa.RecordBatch:
            there = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["bucket", "n"])

        return each, last

    out = np.zeros(buckets, np.int64)
    for bucket, n in map_slices(features.select("buckets"), work, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed shares' ratio, rounded down."""
    k = len(corpus)
    s, t = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of a document, in thousandths, from a hash of its number."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document (doc_id, text), towards the texts of target (text).

    weight is the mean gain of a document's features, rounded down (none: 0),
    score adds Gumbel noise, so that the highest scores are a draw without
    replacement in proportion to exp(weight). Of the documents with at least
    `least_words` words that percentage has a rank, by score, ties by doc_id.

    A null text has no words; a null doc_id hashes as empty and comes first of
    a tie; repeated rows are ranked each, in any order; an empty corpus gives
    no rows, and an empty target gives gains of its smoothed counts. Texts are
    read once, whole: their buckets are written to the shared folder for both the counts and the weights.
    """
    features = stored(hashed_features(docs, most, buckets), "features")
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most, buckets)
    gains = bucket_gains(histogram(features, buckets), histogram(wanted, buckets))

    def work():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.column("n_features").to_numpy()
            total = np.concatenate([[0], np.cumsum(gains[_unpacked(batch.column("buckets"), buckets)])])
            ends = np.cumsum(n)
            weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
            score = weight + np.array([noise(seed, i) for i in batch.column("doc_id").to_pylist()], np.int64)
            fit = pa.compute.greater_equal(batch.column("n_words"), least_words)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_features"), pa.array(weight), pa.array(score), fit], names=["doc_id", "n_features", "weight", "score", "fit"])

        return each

    scored = stored(map_slices(features, work, "doc_id long, n_features long, weight long, score long, fit boolean"), "scored")
    drawn = percent * scored.where("fit").count() // 100
    places = numbered(scored, F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return places.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("at") < drawn), F.col("at") + 1).alias("rank"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
