"""Graphs, places, running sums, word lists and stored versions against plain forms."""

import random
import threading
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, indicators, news, ordering
from tidemark.shared import scratch, stored
from tidemark.sources import store
from tidemark.sources.readers import REGISTRY


def in_order(edges):
    gone = set()
    for b in sorted({b for _, b in edges}):
        if any(y == b and a not in gone for a, y in edges):
            gone.add(b)
    return gone


def roots(edges):
    root = {n: n for e in edges for n in e}
    while True:
        new = dict(root)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new


PICK = random.Random(9)
GRAPHS = {
    "none": [],
    "pair": [(1, 2)],
    "chain": [(k, k + 1) for k in range(24)],
    "early hub": [(0, k) for k in range(1, 60)],
    "late hub": [(k, 99) for k in range(60)],
    "clique": [(a, b) for a in range(14) for b in range(a + 1, 14)],
    "random": sorted({tuple(sorted(PICK.sample(range(70), 2))) for _ in range(90)}),
    "two stars and a bridge": [(5, k) for k in range(10, 40)] + [(k, 90) for k in range(20, 45)] + [(90, 91), (91, 92)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    got = {r["b"]: r["a"] for r in graph.components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()}
    assert got == {n: r for n, r in roots(edges).items() if n != r}


@pytest.mark.parametrize(("name", "most"), [*((g, 100_000) for g in GRAPHS), ("chain", 7), ("late hub", 4), ("clique", 5), ("random", 6), ("two stars and a bridge", 3)])
def test_greedy_drops(spark, name, most):
    edges = GRAPHS[name]
    got = [r["seq"] for r in graph.greedy_drops(spark.createDataFrame(edges, "a long, b long"), most).collect()]
    assert len(got) == len(set(got)) and set(got) == in_order(edges)


def test_a_hub_is_not_one_task(spark):
    """No plan of the greedy choice puts all edges into one group: tasks take components of at most `most` edges."""
    edges = spark.range(1, 30_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert graph.greedy_drops(edges, 1000).count() == 29_999


def test_numbered(spark):
    rows = [(PICK.randint(0, 5), PICK.randint(0, 900), k) for k in range(500)] + [(None, 3, 500)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(7)
    got = ordering.numbered(df, F.col("a").desc_nulls_last(), F.col("b"), F.col("c")).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["at"])] == want and sorted(r["at"] for r in got) == list(range(501))
    assert ordering.numbered(df.limit(0), "a").collect() == []


def test_running_sums(spark):
    rows = [("hot", k, float(k % 7), 1) for k in range(400)] + [(f"k{k % 30}", k, 0.5, k) for k in range(200)]
    got = ordering.running_sums(spark.createDataFrame(rows, "g string, at int, x double, y long").repartition(6), "g", "at", ["x", "y"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        for r, x, y in zip(mine, accumulate(r[2] for r in mine), accumulate(r[3] for r in mine), strict=True):
            want[g, r[1]] = (x, y)
    assert {(r["g"], r["at"]): (r["x"], r["y"]) for r in got} == want


def test_match_words(spark):
    texts = ["The War began", "oil", None, "", "warm weather", "ÉTÉ à Paris", "oil and war"]
    lists = [("a", ["war", "oil"]), ("b", ["été"]), ("c", []), ("d", [""]), ("e", None), ("f", ["zz", None, "war", "war"]), ("g", ["ar", "warm w"])]
    articles, events = spark.createDataFrame(list(enumerate(texts)), "seq long, t string"), spark.createDataFrame(lists, "code string, keywords array<string>")
    want = {(k, s) for s, t in enumerate(texts) if t is not None for k, ws in lists for w in ws or [] if w is not None and w in t.lower()}
    for block in (16_000_000, 20):
        got = [tuple(r) for r in news.match_words(articles, events, F.col("t"), block_bytes=block).collect()]
        assert sorted(got) == sorted(want)
    assert news.match_words(articles, events.limit(0), F.col("t")).collect() == []


def test_latest_of_repeated_dates(spark):
    """The last to come in counts, in whatever order rows lie, from one shuffle."""
    rows = [("s", k // 3, k, float(PICK.randint(1, 9))) for k in range(60)]
    want = None
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        obs = spark.createDataFrame(mixed, "series_id string, date int, ingest int, value double").repartition(3)
        made = indicators.history(indicators.keep_latest(obs))
        got = sorted(tuple(r) for r in made.collect())
        assert want in (None, got) and len(got) == 20
        want = got
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(series_id") == 1
    assert [r[2] for r in want] == [r[3] for r in rows if r[2] % 3 == 2]


def test_store(spark, tmp_path):
    folder = str(tmp_path / "registry")
    rows = spark.createDataFrame([("A", "k1", " 1", "30", "2024-01-01", "Lifetime", "Active", "", "", "")], REGISTRY)
    with pytest.raises(FileNotFoundError):
        store.load_registry(spark, folder)
    assert store.save_registry(rows, folder) == 1
    revoke = lambda r: r.withColumn("status", F.lit("Revoked"))
    assert store.change_registry(spark, folder, revoke) == 2
    assert [r["status"] for r in store.load_registry(spark, folder).collect()] == ["Revoked"]
    # A write that fails leaves the version before it.
    with pytest.raises(Exception, match="(?i)zero"):
        store.change_registry(spark, folder, lambda r: r.withColumn("status", F.expr("CAST(1 / (length(key) - 2) AS STRING)")))
    assert [r["status"] for r in store.load_registry(spark, folder).collect()] == ["Revoked"]
    # So does a writer that was cut off when its marker was made.
    (tmp_path / "registry" / "_versions" / f"{3:020d}").write_text("")
    assert max(store.versions(spark, folder)) == 2
    # Another writer comes between: the change begins again from what it left.
    calls = []

    def late(r):
        calls.append(1)
        if len(calls) == 1:
            store.change_registry(spark, folder, lambda x: x.withColumn("client_name", F.lit("B")))
        return r.withColumn("duration", F.lit("60"))

    assert store.change_registry(spark, folder, late) == 5 and len(calls) == 2
    assert [(r["client_name"], r["duration"], r["status"]) for r in store.load_registry(spark, folder).collect()] == [("B", "60", "Revoked")]
    with pytest.raises(store.Conflict):
        store.save_registry(rows, folder, after=3)
    store.forget(spark, folder, keep=1)
    assert len([p for p in (tmp_path / "registry").iterdir() if p.name.startswith("data-")]) == 1
    assert store.load_registry(spark, folder).count() == 1


def test_stored_sessions(spark, tmp_path):
    rows = [(f"d{k}", "K", "PC", "now", 'a "b"', None, k % 2 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "device_id string, key string, dev_type string, last_active string, user_name string, expiry_info string, is_admin boolean")
    store.save_sessions(df, str(tmp_path / "s"))
    assert sorted(map(tuple, store.load_sessions(spark, str(tmp_path / "s")).collect()), key=repr) == sorted(rows, key=repr)


def test_scratch_of_another_thread(spark):
    """A table that another thread writes while a block is open here is not deleted with it."""
    kept = []
    with scratch(spark):
        mine = stored(spark.range(3), "mine")
        other = threading.Thread(target=lambda: kept.append(stored(spark.range(5), "other")))
        other.start()
        other.join()
        assert mine.count() == 3
    assert kept[0].count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        mine.count()
