"""Components of a graph, and the greedy choice of nodes in order, over edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Edges that one task may decide at once.
MOST = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """a, b: each node b of the edges (a < b) but the least of its component, with that least node a.

    Stars alternate: every node ties its greater neighbours to its least
    neighbour, then its smaller ones and itself, until nothing changes, which
    takes a number of rounds in the logarithm of the longest path. The least
    neighbours are a table, so that the join can split the edges of a node that very many share.
    """
    edges = stored(edges.select("a", "b").distinct(), "component-edges")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "component-large")
        least = stored(large.groupBy("b").agg(F.min("a").alias("m")), "component-least")
        tied = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = stored(tied.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "component-edges")
        before, state = state, _state(edges)
        if state == before:
            return edges


def _in_order(pairs: pd.DataFrame) -> pd.DataFrame:
    """seq, kept of all nodes of the edges, decided one after the other."""
    gone: set[int] = set()
    for a, b in pairs.sort_values(["b", "a"], kind="stable")[["a", "b"]].itertuples(index=False):
        if a not in gone:
            gone.add(b)
    nodes = pd.unique(pairs[["a", "b"]].to_numpy().ravel())
    return pd.DataFrame({"seq": nodes, "kept": [n not in gone for n in nodes.tolist()]})


def greedy_drops(edges: DataFrame, most: int = MOST) -> DataFrame:
    """seq of the nodes that go when, in order, each goes if it has an edge to an earlier one that stays; edges (a < b).

    In rounds. Nodes without an earlier undecided neighbour stay and their
    neighbours go, whatever their number, as long as that decides most edges. Then each component of the edges left
    with at most `most` of them is decided by one task, in order. Of larger
    components the edges are decided that end before the node where the first
    `most` edges end: no later node bears on these. So a long chain takes a
    round for each `most` edges, and no task sees more than that.
    """
    spark = edges.sparkSession
    edges = stored(edges.select("a", "b").distinct(), "greedy-edges")
    dropped = spark.createDataFrame([], "seq long")

    def settle(edges: DataFrame, kept: DataFrame, gone: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Edges between nodes still undecided, and all nodes that go as the kept ones stay."""
        more = edges.join(kept.withColumnRenamed("seq", "a"), "a", "left_semi").select(F.col("b").alias("seq"))
        gone = stored((more if gone is None else more.unionByName(gone)).distinct(), "greedy-gone")
        for end in "ab":
            edges = edges.join(gone.withColumnRenamed("seq", end), end, "left_anti")
        return stored(edges.select("a", "b"), "greedy-edges"), gone

    n = edges.count()
    while n:
        kept = edges.select(F.col("a").alias("seq")).distinct().join(edges.select(F.col("b").alias("seq")), "seq", "left_anti")
        edges, gone = settle(edges, kept, None)
        dropped = dropped.unionByName(gone)
        before, n = n, edges.count()
        if 2 * n < before:
            continue  # rounds that decide most edges are cheaper than components
        tied = components(edges)
        roots = tied.unionByName(tied.select("a", F.col("a").alias("b")).distinct()).select(F.col("a").alias("root"), F.col("b").alias("a"))
        rooted = stored(edges.join(roots, "a"), "greedy-rooted")
        sizes = stored(rooted.groupBy("root").agg(F.count("*").alias("n")), "greedy-sizes")
        large = rooted.join(sizes.where(F.col("n") > most), "root", "left_semi")
        # The node where the first `most` edges of large components end: none if there are no such components.
        last = large.select("b").orderBy("b").limit(most + 1).agg(F.max("b").alias("last")).first()["last"]
        fit = rooted.join(sizes.where(F.col("n") <= most), "root", "left_semi")
        if last is not None:
            fit = fit.unionByName(large.where(F.col("b") < last))
        decided = stored(fit.groupBy("root").applyInPandas(_in_order, "seq long, kept boolean"), "greedy-decided")
        edges, gone = settle(edges, decided.where("kept").select("seq"), decided.where("NOT kept").select("seq"))
        dropped, n = dropped.unionByName(gone), edges.count()
    return dropped.distinct()
