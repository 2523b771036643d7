"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The top of the tree is fitted on at most SAMPLE vectors. All rows are sent down
it, and leaves that gather more than twice LEAF rows are split by trees fitted
in tasks of their own, on at most SPLIT vectors each, until leaves are small
whatever the number of rows; so what a query compares does not grow with the
table. The driver and the tasks hold the centres, one for about LEAF rows and
at most MAX_LEAVES (256 MB for vectors of 64 numbers); beyond that leaves grow.

A query keeps the children it has not entered in a priority queue, by inner
product with their centres, and always enters the best one; the order in which
it meets leaves is its visiting order. How many leaves all queries visit is
calibrated: for some queries the true neighbours are found by brute force over
all rows, and the number of visits is widened until the wanted share of them
lies in the visited leaves. A query whose leaves hold too few rows goes on.

A bucket is a run of leaves, neighbours in the tree, with about BUCKET rows; a
leaf with more rows is several buckets. Rows go to their bucket once, queries
to the buckets they ask. A bucket that very many queries ask is dealt out as
often as they need, QUERY_BLOCK queries to each.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, map_slices, stored, table

SAMPLE, BRANCH, LEAF, ROUNDS = 20_000, 16, 512, 8
#: Rows of a leaf that its split is fitted on, and the least of a sample's rows in a leaf.
SPLIT, LEAST, MAX_LEAVES = 8192, 16, 1 << 20
CALIBRATION, RECALL = 200, 0.95
BUCKET, QUERY_BLOCK = 4096, 4096


class Tree:
    """centres[k]: centres of the children of inner node k; child[k]: their nodes, or -1 - leaf."""

    def __init__(self, x: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 7) -> None:
        self.centres: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self._r = np.random.default_rng(seed)
        self.root = self._grow(x, branch, leaf)

    def graft(self, trees: dict[int, Tree]) -> None:
        """Puts a tree in the place of a leaf; its first leaf keeps the number, the others get new ones."""

        def moved(node: int, leaf: int, nodes: int, leaves: int) -> int:
            return node + nodes if node >= 0 else node - leaves + 1 if node < -1 else -1 - leaf

        at: dict[int, int] = {}
        for leaf, tree in trees.items():
            nodes, leaves = len(self.centres), self.leaves
            self.centres += tree.centres
            self.child += [[moved(c, leaf, nodes, leaves) for c in several] for several in tree.child]
            self.leaves += tree.leaves - 1
            at[-1 - leaf] = moved(tree.root, leaf, nodes, leaves)
        old = len(self.child) - sum(len(t.child) for t in trees.values())
        self.child[:old] = [[at.get(c, c) for c in several] for several in self.child[:old]]
        self.root = at.get(self.root, self.root)

    def order(self) -> list[int]:
        """Leaves as they lie in the tree."""
        found, left = [], [self.root]
        while left:
            node = left.pop()
            if node < 0:
                found.append(-1 - node)
            else:
                left += reversed(self.child[node])
        return found

    def _grow(self, x: np.ndarray, branch: int, leaf: int) -> int:
        centres = self._means(x, branch) if len(x) > leaf else None
        if centres is None:
            self.leaves += 1
            return -self.leaves
        near = nearest(x, centres)
        used = np.unique(near)
        node = len(self.centres)
        self.centres.append(centres[used])
        self.child.append([])
        self.child[node] = [self._grow(x[near == k], branch, leaf) for k in used]
        return node

    def _means(self, x: np.ndarray, k: int) -> np.ndarray | None:
        """Lloyd's rounds from k different rows; None if all rows are alike."""
        start = np.unique(x[self._r.permutation(len(x))[: 4 * k]], axis=0)
        if len(start) < 2:
            start = np.unique(x, axis=0)
        if len(start) < 2:
            return None
        centres = start[self._r.permutation(len(start))[:k]]
        for _ in range(ROUNDS):
            near = nearest(x, centres)
            count = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        return centres if len(np.unique(nearest(x, centres))) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node on to the nearest centre."""
        out = np.zeros(len(x), np.int64)
        left = [(self.root, np.arange(len(x)))]
        while left:
            node, rows = left.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            near = nearest(x[rows], self.centres[node])
            left += [(c, rows[near == k]) for k, c in enumerate(self.child[node]) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue, order = [(0.0, 0, self.root)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for score, c in zip((self.centres[node] @ q).tolist(), self.child[node], strict=True):
                heapq.heappush(queue, (-score, order, c))
                order += 1


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def usable(vector: Column) -> Column:
    """Not null, not empty, some component other than 0, none null, NaN or infinite."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, asked: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows and scores of its k largest inner products, each id once, ties to the smaller id, its own id left out.

    asked (queries, rows) says which rows a query looks at; all if None.

    Scores come from one way of summing, so equal vectors have equal scores wherever they lie.
    """
    rough, out = q @ x.T, []
    repeats = len(np.unique(ids)) < len(ids)
    if asked is not None:
        rough[~asked] = -np.inf
    for row, me, v in zip(rough, own, q, strict=True):
        row[ids == me] = -np.inf
        n = min(k, len(row))
        bar = np.partition(row, len(row) - n)[len(row) - n] if n else 0
        at = np.flatnonzero((row >= bar - 1e-9 * (1 + abs(bar))) & (row > -np.inf)) if np.isfinite(bar) else np.flatnonzero(row > -np.inf)
        if repeats:
            at = np.flatnonzero(row > -np.inf)
        score = (x[at] * v).sum(axis=1)
        order = np.lexsort((ids[at], -score))
        if repeats:  # the best row of each id
            order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
        order = order[:k]
        out.append((at[order], score[order]))
    return out


def top(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (and leaf) of the k best rows of each query, a vec_id once."""
    once = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("leaf").alias("leaf"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


FOUND = "query_id long, vec_id long, score double, leaf long"


def _found(parts: list[tuple]) -> dict:
    """Columns of FOUND from (query ids, [(rows, scores)], ids, leaves)."""
    query, vec, score, leaf = [], [], [], []
    for own, hits, ids, leaves in parts:
        for me, (at, s) in zip(own, hits, strict=True):
            query.append(np.full(len(at), me, np.int64))
            vec.append(ids[at])
            score.append(s)
            leaf.append(leaves[at])
    join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
    return {"query_id": join(query, np.int64), "vec_id": join(vec, np.int64), "score": join(score, np.float64), "leaf": join(leaf, np.int64)}


def exhaustive(queries: tuple[np.ndarray, np.ndarray], rows: DataFrame, k: int) -> DataFrame:
    """True neighbours of a few queries (ids, vectors; a bounded number, broadcast) over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, q = held.value
            ids = batch.column("vec_id").to_numpy()
            return pa.RecordBatch.from_pydict(_found([(own, best(q, own, matrix(batch.column("v")), ids, k), ids, batch.column("leaf").to_numpy())]))

        return each

    return top(map_slices(rows.select("vec_id", "v", "leaf"), work, FOUND, rows=8192), k)


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows (vec_id, v, q) with the leaf of each."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def assign() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.assign(matrix(batch.column("v"))))], [*batch.schema.names, "leaf"])

        return each

    return map_slices(rows, assign, "vec_id long, v array<double>, q boolean, leaf long", rows=4096)


def _small(spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
    """A table of a row for each leaf at most."""
    return F.broadcast(spark.createDataFrame(pa.table(columns).to_pandas(), ", ".join(f"{c} {'double' if v.dtype.kind == 'f' else 'long'}" for c, v in columns.items())))


def build(rows: DataFrame, sample: int = SAMPLE) -> tuple[Tree, np.ndarray] | None:
    """The tree over rows (vec_id, v, q) and the number of rows in each leaf; None without rows."""
    spark, n = rows.sparkSession, rows.count()
    some = hash_sample(rows.select("vec_id", "v"), ["vec_id"], sample).select("v").toPandas()["v"]
    if not len(some):
        return None
    tree = Tree(np.stack(some.to_list()), max(LEAST, LEAF * len(some) // n))
    alike: set[int] = set()  # leaves that cannot be split, as all their vectors are one
    while True:
        size = np.zeros(tree.leaves, np.int64)
        assigned = _assigned(rows, tree)
        for r in assigned.groupBy("leaf").count().collect():
            size[r["leaf"]] = r["count"]
        big = np.array([k for k in np.flatnonzero(size > 2 * LEAF) if k not in alike], np.int64)
        if not len(big) or tree.leaves >= MAX_LEAVES:
            return tree, size
        share = np.minimum(1.0, SPLIT / size[big])

        def split(group: pa.Table) -> pa.Table:
            x, part = matrix(group.column("v").combine_chunks()), group.column("share")[0].as_py()
            found = Tree(x, max(LEAST, int(LEAF * part)))
            return pa.table({"leaf": group.column("leaf")[:1], "tree": pa.array([pickle.dumps(found)], pa.binary())})

        chosen = assigned.join(_small(spark, {"leaf": big, "share": share}), "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        trees = {r["leaf"]: pickle.loads(r["tree"]) for r in chosen.select("leaf", "share", "v").groupBy("leaf").applyInArrow(split, "leaf long, tree binary").collect()}
        alike |= {int(k) for k in big if k not in trees or trees[k].leaves == 1}
        tree.graft({k: t for k, t in trees.items() if t.leaves > 1})


def buckets(tree: Tree, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first bucket and how many it has."""
    several = np.maximum(1, -(-size // BUCKET))
    first, at, filled = np.zeros(tree.leaves, np.int64), 0, 0
    for leaf in tree.order():
        if filled and filled + size[leaf] > BUCKET:
            at, filled = at + 1, 0
        first[leaf] = at
        if several[leaf] > 1:
            at, filled = at + several[leaf], 0
        else:
            filled += size[leaf]
    return first, several


def ask(indexed: DataFrame, queries: DataFrame, tree: Tree, size: np.ndarray, k: int, visits: int, least: int) -> DataFrame:
    """The k best rows of each query (query_id, v) in the leaves it visits: `visits` of them, and more until they hold `least` rows."""
    spark = indexed.sparkSession
    held = spark.sparkContext.broadcast((tree, size, *buckets(tree, size)))

    def wanted() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        tree, size, first, several = held.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, into, leaves = [], [], []
            for k, v in enumerate(matrix(batch.column("v"))):
                own: dict[int, list[int]] = {}
                n = held_rows = 0
                for leaf in tree.visit(v):
                    if n >= visits and held_rows >= least:
                        break
                    n, held_rows = n + 1, held_rows + int(size[leaf])
                    for b in range(first[leaf], first[leaf] + several[leaf]):
                        own.setdefault(b, []).append(leaf)
                rows += [k] * len(own)
                into += own
                leaves += own.values()
            take = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("v").take(take), pa.array(into, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "w", "bucket", "leaves"])

        return each

    # A stated number of tasks, as adaptive execution would join the few bytes of many queries into one.
    spread = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    asked = stored(map_slices(spread, wanted, "query_id long, w array<double>, bucket long, leaves array<long>", rows=64), "kmeans-asked")
    blocks = asked.groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    asked = asked.join(blocks, "bucket").select("query_id", "w", "leaves", "bucket", F.pmod(F.xxhash64("query_id"), "blocks").alias("block"))
    first, several = buckets(tree, size)
    where = _small(spark, {"leaf": np.arange(tree.leaves), "first": first, "several": several})
    placed = indexed.join(where, "leaf").select("leaf", "vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("several"))).alias("bucket"))
    placed = placed.join(blocks, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "leaf", "vec_id", "v")

    def compare(key: tuple, rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return pa.table(_found([]))
        ids, leaf = rows.column("vec_id").to_numpy(), rows.column("leaf").to_numpy()
        x, q = (matrix(t.column(c).combine_chunks()) for t, c in ((rows, "v"), (asks, "w")))
        own, leaves = asks.column("query_id").to_numpy(), asks.column("leaves").to_pylist()
        here, number = np.unique(leaf, return_inverse=True)
        parts = []
        for at in range(0, len(own), 64):
            some = slice(at, at + 64)
            looks = np.zeros((len(own[some]), len(here)), bool)
            for row, asks_for in zip(looks, leaves[some], strict=True):
                row[np.isin(here, asks_for)] = True
            parts.append((own[some], best(q[some], own[some], x, ids, k, looks[:, number]), ids, leaf))
        return pa.table(_found(parts))

    return top(placed.groupBy("bucket", "block").cogroup(asked.groupBy("bucket", "block")).applyInArrow(compare, FOUND), k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row among all rows but its own, ties to the smaller vec_id.

    vectors has vec_id and embedding. Rows with null vec_id, with a vector
    that is not usable(), or of another length than most take no part. A
    vec_id that comes more than once is found once, by its best row, and asked
    once, with the least of its vectors. Fewer than k candidates: all of them.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    rows = rows.where(F.size("v") == (width["n"] if width else 0))
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    built = build(rows, sample)
    if built is None:
        return none
    tree, size = built
    indexed = stored(_assigned(rows, tree), "kmeans-tree")
    queries = stored(indexed.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "query_id"), "kmeans-queries")
    trial = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).toPandas()
    if not len(trial):
        return none
    own, q = trial["query_id"].to_numpy(), np.stack(trial["v"].to_list())
    true = exhaustive((own, q), indexed, k).select("query_id", "leaf").toPandas()
    turn = {i: np.argsort(list(tree.visit(v))) for i, v in zip(own.tolist(), q, strict=True)}  # leaf -> when it is visited
    needed = np.array([turn[i][leaf] for i, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    visits = 1
    while visits < tree.leaves and len(needed) and (needed < visits).mean() < recall:
        visits += max(1, visits // 8)
    out, least = none, k + 1
    while True:
        found = stored(ask(indexed, queries, tree, size, k, visits, least).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "kmeans-found")
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        queries = stored(queries.join(full, "query_id", "left_anti"), "kmeans-short")
        if least >= size.sum() or queries.isEmpty():
            return out.unionByName(found)
        # Their rows were few, as some have one vec_id: these queries visit more leaves.
        out, least = out.unionByName(found.join(queries, "query_id", "left_anti")), 16 * least


def op7_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
