"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are words (hashed), pairs of character classes (shape of the text) and
bucketed shares of repeated word windows and lines, weighted by tf-idf with the
document frequencies of the whole corpus. A singular value decomposition of the
labelled documents' term matrix gives the latent space. The labelled vectors
(at most 2 * PER_CLASS of them) are broadcast; every document is multiplied
with all of them, in blocks, and the labels of the nearest vote with their
similarities; of equally near ones those with the least doc_id vote.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, text_column
from .labelled import fold, labelled_sample

PER_CLASS, LATENT, NEIGHBOURS = 2000, 48, 15
#: Buckets of words, and the weight of all words of a text beside that of its shape.
WORDS, WORD_WEIGHT = 1 << 13, 0.35
TRIM = b".,;:!?\"'()[]{}<>|*#$%&-_"
#: Distinct words that a worker remembers; beyond this it starts anew.
MEMO_WORDS = 500_000
#: Similarities are compared in steps of this size, so that equal vectors tie whatever block they are multiplied in.
GRAIN = 1e-5
#: Characters by class; other ASCII signs share one class, all beyond ASCII another.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "|", "#", "*$", "%&", "<>", "'\"", "@_/:;=-"]
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
N_CLASSES = len(CLASSES) + 2
PAIRS, SHAPES = N_CLASSES * N_CLASSES, N_CLASSES * N_CLASSES + 2 * len(SHARES)
N_TERMS = SHAPES + WORDS
SPARSE = np.dtype([("at", "<u2"), ("v", "<f4")])


def _class_of_byte() -> np.ndarray:
    of = np.full(256, len(CLASSES), np.int64)
    of[128:] = len(CLASSES) + 1
    for k, chars in enumerate(CLASSES):
        of[list(chars.encode())] = k
    return of


class _Buckets(dict):
    """word -> bucket of its lower-case form without signs around it."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = zlib.crc32(word.lower().strip(TRIM)) % WORDS
        return n


_buckets = _Buckets()


def terms(texts: list[str]) -> np.ndarray:
    """Term weights before idf: square roots of shares of pairs and of words, and one term each for the share of repeats."""
    of, out = _class_of_byte(), np.zeros((len(texts), N_TERMS), np.float32)
    if len(_buckets) > MEMO_WORDS:
        _buckets.clear()
    bucket = _buckets.__getitem__
    for row, text in zip(out, texts, strict=True):
        raw = text.encode()
        kind = of[np.frombuffer(raw, np.uint8)]
        pairs = np.bincount(kind[:-1] * N_CLASSES + kind[1:], minlength=PAIRS)
        row[:PAIRS] = np.sqrt(pairs / max(1, pairs.sum()))
        words = raw.split()
        seen = np.bincount(np.fromiter(map(bucket, words), np.int64, len(words)), minlength=WORDS)
        row[SHAPES:] = WORD_WEIGHT * np.sqrt(seen / max(1, len(words)))
        windows = max(1, len(words) - 2)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        for k, (n, distinct) in enumerate(((windows, len(set(zip(words, words[1:], words[2:], strict=False)))), (len(lines), len(set(lines))))):
            share = (n - distinct) / n if n and len(words) > 2 else 0.0
            row[PAIRS + k * len(SHARES) + int(np.searchsorted(SHARES, share, "right")) - 1] = 0.5
    return out


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of all documents and, for each term, of those that have it: one sum a task, N_TERMS rows in the end."""

    def work() -> tuple[Callable, Callable]:
        total = np.zeros(N_TERMS + 1, np.int64)

        def each(batch: pa.RecordBatch) -> None:
            total[:-1] += (terms(batch.column("text").to_pylist()) > 0).sum(axis=0)
            total[-1] += batch.num_rows

        return each, lambda: pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], ["term", "n"])

    found = map_slices(docs.select(text_column().alias("text")), work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(N_TERMS + 1, np.int64)
    for r in found:
        total[r["term"]] = r["n"]
    return int(total[-1]), total[:-1]


def principal_axes(x: np.ndarray, n: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """The first n right singular vectors of x, by subspace iteration."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], min(n + 16, *x.shape))).astype(x.dtype))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :n]


class Model:
    """Latent space and labelled vectors, from term weights (n, N_TERMS) and labels of documents in the order of their ids."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray, n_docs: int, frequencies: np.ndarray) -> None:
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + n_docs) / (1 + frequencies)).astype(np.float32) + 1
        if len(weights):
            self.axes = principal_axes(weights * self.idf, LATENT).astype(np.float32)
            self.vectors = self.latent(weights)

    def latent(self, weights: np.ndarray) -> np.ndarray:
        x = (weights * self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; 0.5 without labels."""
        if not len(self.labels):
            return np.full(len(weights), 0.5)
        near = np.rint(self.latent(weights) @ self.vectors.T / GRAIN).astype(np.int32)
        k = min(NEIGHBOURS, near.shape[1])
        bar = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
        above = near > bar
        level = near == bar
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        at = np.nonzero(chosen)[1].reshape(-1, k)
        votes = np.maximum(np.take_along_axis(near, at, axis=1) * GRAIN, 1e-6) ** 8
        return np.clip((votes * self.labels[at]).sum(axis=1) / votes.sum(axis=1), 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> Model:
    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = terms(batch.column("text").to_pylist())
            out = []
            for row in x:
                at = np.flatnonzero(row)
                some = np.empty(len(at), SPARSE)
                some["at"], some["v"] = at, row[at]
                out.append(some.tobytes())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "x"])

        return each

    rows = map_slices(labelled_sample(docs, labels, label, per_class), work, "doc_id long, label int, x binary").toPandas().sort_values("doc_id", kind="stable")
    weights = np.zeros((len(rows), N_TERMS), np.float32)  # at most 2 * per_class rows
    for to, x in zip(weights, rows.x, strict=True):
        at, v = np.frombuffer(x, SPARSE)["at"], np.frombuffer(x, SPARSE)["v"]
        to[at] = v
    return Model(weights, rows.label.to_numpy(), *document_frequencies(docs))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null text counts as empty, very long texts are read whole. Rows with null
    doc_id are scored and not held out; repeated rows are all scored. Without
    usable labels every score is 0.5; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(terms(batch.column("text").to_pylist())), pa.float64())], ["doc_id", "score"])

        return each

    rows = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")), work, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
