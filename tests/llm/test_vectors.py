"""Tree search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import kmeans_tree

NAN, INF = float("nan"), float("inf")


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 16))
    rows = [(k, (centres[k % 12] + 0.4 * r.standard_normal(16)).tolist()) for k in range(3000)]
    got = found(kmeans_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vec = dict(rows)
    assert all(s == pytest.approx(float(np.dot(vec[q], vec[i])), abs=1e-12) for q, several in got.items() for i, s in several)


def test_hot_vector_and_ties(spark, monkeypatch):
    """A third of all rows are one vector: blocks split it, ties go to the smaller id."""
    monkeypatch.setattr(kmeans_tree, "BUCKET", 50)
    monkeypatch.setattr(kmeans_tree, "QUERY_BLOCK", 7)
    r = np.random.default_rng(5)
    rows = [(k, [1.0, 0.0, 0.0, 0.0] if k % 3 == 0 else r.standard_normal(4).tolist()) for k in range(900)]
    got = found(kmeans_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, recall=1.0))
    want = brute(rows, 20)
    ids, scores = (sum([x[k] for x in got[q]] == [pytest.approx(x[k]) for x in want[q]] for q in want) for k in (0, 1))
    assert min(ids, scores) >= 0.9 * len(want)


def test_tiny_leaves(spark, monkeypatch):
    """Leaves are split in tasks until they hold a few rows each, one visit is enough for the recall asked, and still each query gets its 20."""
    monkeypatch.setattr(kmeans_tree, "LEAF", 4)
    monkeypatch.setattr(kmeans_tree, "LEAST", 2)
    r = np.random.default_rng(6)
    rows = [(k, r.standard_normal(6).tolist()) for k in range(1500)] + [(k, [1.0] * 6) for k in range(1500, 1540)] + [(1541, r.standard_normal(6).tolist()) for _ in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    tree, size = kmeans_tree.build(df.select("vec_id", F.col("embedding").alias("v"), F.lit(False).alias("q")), sample=60)
    assert size.sum() == len(rows) and sorted(tree.order()) == list(range(tree.leaves)) and len(set(tree.visit(np.ones(6)))) == tree.leaves
    assert sorted(size)[-2] <= 8 and size.max() >= 40  # the equal vectors cannot be split
    got = found(kmeans_tree.search(df, F.col("vec_id") % 20 == 0, recall=0.0, sample=60))
    assert set(got) == set(range(0, 1540, 20)) and all(len({i for i, _ in v}) == 20 for v in got.values())


def test_repeated_ids_do_not_crowd_out_others(spark):
    """The nearest rows are one vec_id many times: the query goes on to other leaves."""
    r = np.random.default_rng(2)
    rows = [(0, [1.0, 1.0])] + [(1, [2.0, 2.0 + k * 1e-6]) for k in range(400)] + [(k, (r.standard_normal(2) - 3).tolist()) for k in range(2, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(kmeans_tree.search(df, F.col("vec_id") % 20 == 0, recall=0.0, sample=200))
    assert all(len(v) == 20 for v in got.values())


def test_rows_that_take_no_part(spark):
    odd = [(0, None), (20, [0.0, 0.0]), (40, [NAN, 1.0]), (60, [INF, 1.0]), (80, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (9, [1.0])]
    rows = [(100, [1.0, 0.0]), (101, [0.5, 0.5]), (101, [0.5, 0.5]), (102, [0.0, 1.0])]
    df = spark.createDataFrame(odd + rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(3)).withColumn("v", F.lit("x"))
    assert found(kmeans_tree.search(df, F.col("vec_id") % 20 == 0)) == {100: [(101, 0.5), (102, 0.0)]}
    assert kmeans_tree.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert kmeans_tree.search(df.where("vec_id < 100"), F.col("vec_id") % 20 == 0).count() == 0
