"""Bounded labelled samples for training, and the fold that training leaves out."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo FOLDS; 0 is held out. Null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def usable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of the rows that may train: label 0 or 1, the least of a repeated doc_id, the held-out fold and null doc_id left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def class_sizes(labels: DataFrame, label: str) -> np.ndarray:
    """How many usable rows have label 0 and label 1."""
    n = {r["label"]: r["n"] for r in usable(labels, label).groupBy("label").agg(F.count("*").alias("n")).collect()}
    return np.array([n.get(0, 0), n.get(1, 0)], float)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label of at most per_class training rows of each class, spread over all labels by a hash.

    Labels that are null or not 0 or 1, null doc_id and the held-out fold take
    no part. Of a repeated doc_id the text that sorts first and the lesser label count.
    """
    rows = usable(labels, label)
    some = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # At most 2 * per_class rows of two numbers: small enough to broadcast whatever the size of the corpus.
    chosen = F.broadcast(reduce(DataFrame.unionByName, some))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
