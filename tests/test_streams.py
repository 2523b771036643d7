"""Streams over files give the rows of their batch forms."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators.registry import first_binding
from tidemark.plans import feeds
from tidemark.plans import model as M
from tidemark.streaming import streams as X

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark, tmp_path):
    batch = M.table(spark, SF, "events").orderBy("ts").limit(400)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_hourly(events, tmp_path):
    batch, stream = events
    want = {tuple(r) for r in X.hourly(X.as_articles(batch), feeds.UP, feeds.DOWN).select("window", "n").collect()}
    got = drain(X.hourly(X.as_articles(stream).withWatermark("ts", "1 hour"), feeds.UP, feeds.DOWN), "hourly", tmp_path, "complete")
    assert {tuple(r) for r in got.select("window", "n").collect()} == want


def batches(spark, tmp_path, rows, schema, sizes, name="in"):
    """A stream that takes the rows in micro-batches of the given sizes, a file each, in order."""
    folder, at = tmp_path / name, 0
    folder.mkdir()
    for k, size in enumerate(sizes):
        part = tmp_path / f"{name}-{k}"
        spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.parquet(str(part))
        file = next(part.glob("*.parquet"))
        os.utime(file, (1_000_000 + 10 * k,) * 2)
        file.rename(folder / f"{k:04d}.parquet")
        at += size
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def dealt(n, pick):
    sizes = []
    while sum(sizes) < n:
        sizes.append(min(pick.choice([1, 2, 3, 5, 8, 40]), n - sum(sizes)))
    return sizes


def within(rows, late, pick):
    """The rows, by time, out of order by less than `late`."""
    return sorted(rows, key=lambda r: (r[0] + pick.random() * late, r[1:2]))


LATE = datetime.timedelta(minutes=50)
START = datetime.datetime(2024, 1, 5, 20)


def test_sliding_panes(spark, events, tmp_path):
    """Panes give the windows that articles dealt to twelve windows each give; on a stream, of those the watermark has closed."""
    batch, _ = events
    rows = X.as_articles(batch)
    plain = rows.groupBy(F.window("ts", "1 hour", "5 minutes")).agg(*X._delta(feeds.UP, feeds.DOWN))
    want = {(r["window"]["start"], r["n"], round(r["delta"], 9)) for r in plain.collect()}
    panes = X.sliding(rows, feeds.UP, feeds.DOWN)
    assert {(r["window"]["start"], r["n"], round(r["delta"], 9)) for r in panes.collect()} == want
    times = [(r["ts"], r["event_id"], r["title"]) for r in rows.orderBy("ts").collect()]
    times.append((times[-1][0] + datetime.timedelta(days=3), -1, "end"))
    stream = batches(spark, tmp_path, times, "ts timestamp, event_id long, title string", [100, 150, 150, 1], "panes-in").withWatermark("ts", "1 hour")
    got = X.drained(X.sliding(stream, feeds.UP, feeds.DOWN), str(tmp_path / "panes"))
    assert {(r["window"]["start"], r["n"], round(r["delta"], 9)) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_device_violations_in_any_order(spark, tmp_path, seed):
    """Logins out of order within the watermark, dealt to any micro-batches, give the violations of the batch form."""
    pick = random.Random(seed)
    rows = [(START + datetime.timedelta(minutes=pick.randint(0, 900)), k, pick.randint(1, 3), pick.choice(["PC", "Mobile"]), pick.choice(["", None, "d1", "d2"])) for k in range(120)]
    schema = "login_ts timestamp, login_id long, key long, dev_type string, device_id string"
    want = {(r["key"], r["dev_type"], r["login_id"]) for r in first_binding(spark.createDataFrame(rows, schema)).where("violation").collect()}
    sent = [*within(rows, LATE, pick), (START + datetime.timedelta(days=30), 999, 9, "PC", "x")]
    stream = batches(spark, tmp_path, sent, schema, [*dealt(len(rows), pick), 1])
    got = X.drained(X.device_violations(stream), str(tmp_path / "out")).collect()
    assert {(r["key"], r["dev_type"], r["login_id"]) for r in got} == want and len(got) == len(want) > 10


@pytest.mark.parametrize("seed", [3, 4])
def test_tick_alerts_in_any_batching(spark, tmp_path, seed):
    """A weekend replayed in any micro-batches, ticks split or several in one, gives the alerts of the batch form."""
    pick = random.Random(seed)
    rows = [(START + datetime.timedelta(minutes=pick.randint(0, 3600)), k, pick.choice(["calm", "war now", "missile", "crisis", "quiet", None])) for k in range(160)]
    schema = "ts timestamp, seq long, title string"
    df = spark.createDataFrame(rows, schema).where(F.weekday("ts") >= 5)
    ticked = df.select(F.date_sub(F.to_date("ts"), F.weekday("ts") - 5).alias("weekend"), F.date_trunc("hour", "ts").alias("tick"), "seq", "title", F.coalesce(X.any_word(F.lower("title"), X.EMERGENCY), F.lit(False)).alias("urgent"))
    want = {tuple(r) for r in X.first_of_ticks(ticked).collect()}
    sent = [*within(rows, LATE, pick), (START + datetime.timedelta(days=30), 999, "war now")]
    stream = batches(spark, tmp_path, sent, schema, [*dealt(len(rows), pick), 1])
    got = [tuple(r) for r in X.drained(X.tick_alerts(stream), str(tmp_path / "out")).collect()]
    assert set(got) == want and len(got) == len(want) >= 3


def test_live_history_in_any_order(spark, tmp_path):
    """Observations out of order and dates that come twice give the rows of the batch form."""
    pick = random.Random(5)
    rows = [(START + datetime.timedelta(hours=pick.randint(0, 60)), k, pick.randint(1, 2), float(pick.choice([0, 1, 2, -3, 5.5]))) for k in range(90)]
    schema = "date timestamp, id long, series_id long, value double"
    obs = spark.createDataFrame(rows, schema).withColumnRenamed("id", "ingest")
    columns = ["n", "mom", "qoq", "yoy", "t3m", "z", "score"]
    plain = lambda r: tuple(None if r[c] is None else round(r[c], 9) for c in columns)
    want = {(r["series_id"], r["at"], plain(r)) for r in I.history(I.keep_latest(obs)).withColumn("at", F.unix_micros("date")).collect()}
    sent = [*within(rows, LATE, pick), (START + datetime.timedelta(days=30), 999, 9, 0.0)]
    stream = batches(spark, tmp_path, sent, schema, [*dealt(len(rows), pick), 1])
    got = X.drained(X.live_history(stream), str(tmp_path / "out")).collect()
    assert {(r["series_id"], r["at"], plain(r)) for r in got} == want and len(got) == len(want)


def test_outbox_survives_a_stop(spark, tmp_path):
    """A batch that failed after its messages were written, and one cut off while writing, leave each message once."""
    rows = [(START + datetime.timedelta(minutes=k), "report", f"message {k}") for k in range(12)]
    stream = batches(spark, tmp_path, rows, "ts timestamp, kind string, message string", [4, 4, 4])
    to = spark.createDataFrame([("a",), ("b",), ("a",)], "chat_id string")
    folder, checkpoint = str(tmp_path / "outbox"), str(tmp_path / "checkpoint")
    write = X.outbox_writer(to, folder)

    def stops(batch, number):
        write(batch, number)
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        X.run_to_end(stream, stops, checkpoint)
    for part in (tmp_path / "outbox" / "batch=1").glob("part-*"):
        (part.parent / f"{part.stem}-again.parquet").write_bytes(part.read_bytes())  # a doubled file of the batch that failed
    (tmp_path / "outbox" / "batch=1" / "_SUCCESS").unlink()
    assert {r["batch"] for r in X.read_outbox(spark, folder).collect()} == {0}
    X.run_to_end(stream, write, checkpoint)
    X.run_to_end(stream, write, checkpoint)
    got = [(r["chat_id"], r["message"]) for r in X.read_outbox(spark, folder).collect()]
    assert sorted(got) == sorted((c, m) for c in "ab" for _, _, m in rows)
    assert X.read_outbox(spark, str(tmp_path / "nothing")).collect() == []


def test_weekend_alerts(events, tmp_path):
    batch, stream = events
    want = {tuple(r) for r in X.urgent(X.as_articles(batch), feeds.URGENT).select("weekend", "title").distinct().collect()}
    got = drain(X.weekend_alerts(X.as_articles(stream), feeds.URGENT), "alerts", tmp_path).select("weekend", "title").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == want


def test_sessions(events, tmp_path):
    _, stream = events
    activity = stream.select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"))
    assert drain(X.sessions(activity, "1 hour"), "sessions", tmp_path, "complete").agg(F.sum("n")).first()[0] == 400


def test_hourly_report_of_a_stream(spark, events, tmp_path):
    batch, stream = events
    macro = spark.createDataFrame([("USD", 0.2), ("Gold", -0.4)], "asset string, macro double")
    want = {tuple(r) for r in X.hourly_report(X.hourly(X.as_articles(batch), feeds.UP, feeds.DOWN), macro).select("window", "asset", "score", "strength").collect()}
    got = drain(X.hourly_report(X.hourly(X.as_articles(stream).withWatermark("ts", "1 hour"), feeds.UP, feeds.DOWN), macro), "report", tmp_path, "complete")
    assert {tuple(r) for r in got.select("window", "asset", "score", "strength").collect()} == want and want


def test_tick_alerts_at_rest(spark):
    """The cases of the stream: one alert a tick, the first unseen of the first four."""
    ticks = [[(1, "calm", False), (2, "war", True), (3, "attack", True)], [(4, "war", True), (5, "attack", True)], [(6, "war", True), *((7 + k, f"calm {k}", False) for k in range(3)), (11, "crisis", True)]]
    rows = spark.createDataFrame([(k, *r) for k, tick in enumerate(ticks) for r in tick], "tick int, seq long, title string, urgent boolean").withColumn("weekend", F.lit("2024-01-06").cast("date"))
    assert {(r["seq"], r["title"]) for r in X.first_of_ticks(rows).collect()} == {(2, "war"), (5, "attack")}


def test_waiting_rows_go_to_state_together():
    """A batch of a key's rows is one call to state, and a release one or two, however many rows there are; rows wait in order, the last of two alike counts."""
    import pandas as pd

    calls, held, timers = [], [], []

    class Waiting:
        def appendList(self, rows):  # noqa: N802
            calls.append("append")
            held.extend(rows)

        def get(self):
            calls.append("get")
            return iter(list(held))

        def put(self, rows):
            calls.append("put")
            held[:] = rows

        def clear(self):
            calls.append("clear")
            held.clear()

    class Numbers(X.InOrder):
        VALUE = "value double"

        def released(self, key, rows):
            yield [(at, ident, v) for (at, ident), (v,) in rows]

    class Handle:
        def getListState(self, name, schema):  # noqa: N802
            return Waiting()

        def registerTimer(self, at):  # noqa: N802
            timers.append(at)

    class Upto:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    p = Numbers()
    p.init(Handle())
    rows = pd.DataFrame([(1000 * k, k, float(k)) for k in range(100, 0, -1)] + [(5000, 5, 0.5)], columns=["at", "id", "value"])
    assert list(p.handleInputRows(("x",), iter([rows]), None)) == []
    first = list(p.handleExpiredTimer(("x",), Upto(40), None))
    rest = list(p.handleExpiredTimer(("x",), Upto(1000), None))
    want = [(1000 * k, k, 0.5 if k == 5 else float(k)) for k in range(1, 101)]
    assert [r for part in first for r in part] == want[:40] and [r for part in rest for r in part] == want[40:]
    assert calls == ["append", "get", "put", "get", "clear"] and timers == [2, 42]
