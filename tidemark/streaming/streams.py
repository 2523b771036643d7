"""Structured Streaming forms of the reports, alerts, sentiment and device checks.

hourly, sliding and urgent are plain transformations: the same code runs on a
batch and on a stream (with a watermark on `ts` set before).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pyspark.sql.window import Window

from ..dims import BEARISH, BULLISH, EMERGENCY, HORIZON_WEIGHTS
from ..operators.indicators import bias_label
from ..operators.news import any_word
from ..operators.registry import outbox
from ..operators.scores import asset_points
from ..sources.store import found

#: Local time is a fixed offset from UTC.
OFFSET = "INTERVAL 3 HOURS"


def as_articles(events: DataFrame) -> DataFrame:
    """event_id, ts (local), title from the events table."""
    return events.select("event_id", F.expr(f"CAST(ts AS TIMESTAMP) + {OFFSET}").alias("ts"), F.concat_ws(" ", "event_type", "props").alias("title"))


def _delta(bull: list[str], bear: list[str]) -> list:
    up, down = (any_word(F.lower("title"), w).cast("int") for w in (bull, bear))
    return [F.count("*").alias("n"), (0.04 * (F.sum(up) - F.sum(down))).alias("delta")]


def hourly(articles: DataFrame, bull: list[str] = BULLISH, bear: list[str] = BEARISH) -> DataFrame:
    """window, n, delta for each clock hour of a weekday."""
    return articles.where(F.weekday("ts") < 5).groupBy(F.window("ts", "1 hour")).agg(*_delta(bull, bear))


def sliding(articles: DataFrame, bull: list[str] = BULLISH, bear: list[str] = BEARISH) -> DataFrame:
    """window, n, delta for each hour that starts every five minutes (J3); scores.asset_points() makes points by asset of it.

    Articles are summed in panes of five minutes first, so that a pane and not
    an article goes to the twelve windows it is in. On a stream both sums are of
    closed windows (append mode).
    """
    up, down = (any_word(F.lower("title"), w).cast("int") for w in (bull, bear))
    panes = articles.groupBy(F.window("ts", "5 minutes").alias("pane")).agg(F.count("*").alias("n"), F.sum(up).alias("up"), F.sum(down).alias("down"))
    return panes.groupBy(F.window(F.window_time("pane"), "1 hour", "5 minutes")).agg(F.sum("n").alias("n"), (0.04 * (F.sum("up") - F.sum("down"))).alias("delta"))


def hourly_report(windows: DataFrame, macro: DataFrame) -> DataFrame:
    """window, asset, score, strength: the report of each hour (J1), half the asset's macro score (asset, macro), half the hour's news."""
    rows = asset_points(windows, macro).join(macro, "asset")
    score = F.round(0.5 * F.col("macro") + 0.5 * (F.col("points") / 0.5), 12)
    return rows.select("window", "asset", score.alias("score"), bias_label(score).alias("strength"))


def urgent(articles: DataFrame, words: list[str] = EMERGENCY) -> DataFrame:
    """Weekend articles with an emergency word, with the Saturday of their weekend."""
    rows = articles.where((F.weekday("ts") >= 5) & any_word(F.lower("title"), words))
    return rows.withColumn("weekend", F.date_sub(F.to_date("ts"), F.weekday("ts") - 5))


def weekend_alerts(articles: DataFrame, words: list[str] = EMERGENCY) -> DataFrame:
    """Each urgent title once a weekend (J2). Seen titles are kept for two days, as long as a weekend lasts."""
    return urgent(articles, words).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["weekend", "title"])


def first_of_ticks(articles: DataFrame, top: int = 4) -> DataFrame:
    """weekend, seq, title: at most one alert a tick (J2), of articles (weekend, tick, seq, title, urgent) at rest.

    It is the first urgent title among the first `top` articles of the tick
    that has not been alerted that weekend. A task takes a weekend, whose ticks bound its rows.
    """
    rows = articles.withColumn("rank", F.row_number().over(Window.partitionBy("weekend", "tick").orderBy("seq"))).where((F.col("rank") <= top) & F.col("urgent"))

    def alerts(weekend: pd.DataFrame) -> pd.DataFrame:
        seen, out, done = set(), [], None
        for r in weekend.sort_values(["tick", "seq"], kind="stable").itertuples():
            if r.tick != done and r.title not in seen:
                seen.add(r.title)
                out.append((r.weekend, r.seq, r.title))
                done = r.tick
        return pd.DataFrame(out, columns=["weekend", "seq", "title"])

    return rows.select("weekend", "tick", "seq", "title").groupBy("weekend").applyInPandas(alerts, "weekend date, seq long, title string")


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their times: they wait in state until the watermark has passed them.

    Rows have `at` (microseconds) and `id`; VALUE names the other columns that
    wait with them, with their types. Spark drops rows behind the watermark, so
    none can follow that belongs before a released one, and what is released
    does not hang on how rows were dealt to micro-batches. One timer stands at
    the earliest waiting row of a batch. A key's rows are put into state and
    taken out together, as each call goes to the JVM and back.
    """

    VALUE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, id long, {self.VALUE}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        names = [x.split()[0] for x in self.VALUE.split(", ")]
        first = None
        for batch in rows:
            new = [(int(at), int(ident), *(None if pd.isna(v) else v for v in value)) for at, ident, *value in batch[["at", "id", *names]].itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                first = min(r[0] for r in new) if first is None else min(first, min(r[0] for r in new))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        # Of rows alike in time and id the last to come counts.
        rows = sorted({tuple(r[:2]): tuple(r[2:]) for r in map(tuple, self.waiting.get())}.items(), key=lambda r: r[0])
        due = [r for r in rows if r[0][0] <= upto]
        if due and len(due) < len(rows):
            self.waiting.put([(*k, *v) for k, v in rows[len(due) :]])
        elif due:
            self.waiting.clear()
        if len(due) < len(rows):
            self.handle.registerTimer(rows[len(due)][0][0] // 1000 + 1)
        if due:
            yield from self.released(key, due)

    def released(self, key: tuple, rows: list[tuple[tuple, tuple]]) -> Iterator[pd.DataFrame]:
        """What the rows ((at, id), value), the next in order, give."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class DeviceBinding(InOrder):
    """First device of a (key, class) binds; other devices are violations (J4). Beside waiting rows, one value of state for each key."""

    VALUE = "device_id string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bound = handle.getValueState("bound", "device_id string")

    def released(self, key: tuple, rows: list[tuple[tuple, tuple]]) -> Iterator[pd.DataFrame]:
        bound, out = self.bound.get()[0] if self.bound.exists() else None, []
        for (_, login), (device,) in rows:
            device = device or ""
            if bound is None and device:
                bound = device
                self.bound.update((bound,))
            elif bound is not None and device != bound:
                out.append((key[0], key[1], login, device))
        yield pd.DataFrame(out, columns=["key", "dev_type", "login_id", "device_id"])


class Horizons(InOrder):
    """The row of indicators.history() for each observation of a series, as it arrives (C2 to C8): a ring of the last 12 values and a count.

    Of observations with one date the last by `id` counts.
    """

    VALUE = "value double"
    KEPT = 12

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "n long, past array<double>")

    def released(self, key: tuple, rows: list[tuple[tuple, tuple]]) -> Iterator[pd.DataFrame]:
        n, past = self.ring.get() if self.ring.exists() else (0, [])
        past, out = list(past), []
        for at, value in {at: value for (at, _), (value,) in rows}.items():
            n += 1
            past.append(value)
            out.append((key[0], at, value, n, *horizons(past, n)))
            past = past[-self.KEPT :]
        self.ring.update((n, past))
        yield pd.DataFrame(out, columns=["series_id", "at", "value", "n", "mom", "qoq", "yoy", "t3m", "z", "score"])


def horizons(past: list[float], n: int) -> tuple[float | None, ...]:
    """mom, qoq, yoy, t3m, z and the unsigned score at the last of a series' values, of which n there were and 13 are enough."""

    def change(new: float, old: float) -> float | None:
        return (new - old) / abs(old) * 100 if old else None

    mean = lambda x: sum(x) / len(x)
    v = past[-1]
    mom = (change(v, past[-2]) or 0.0) if n >= 2 else None
    qoq = (change(mean(past[-3:]), mean(past[-6:-3])) or 0.0) if n >= 6 else None
    yoy = (change(v, past[-13]) or 0.0) if n >= 13 else None
    steps = [c for c in (change(b, a) for a, b in zip(past[-4:], past[-3:], strict=False)) if c is not None]
    t3m = mean(steps) if n >= 4 and steps else None
    last = past[-12:]
    spread = mean([(x - mean(last)) ** 2 for x in last]) ** 0.5
    z = (v - mean(last)) / spread if n >= 6 and spread > 0 else 0.0
    squashed = [w * math.tanh((x or 0.0) / scale) for x, (w, scale) in zip((mom, qoq, yoy, t3m, z), HORIZON_WEIGHTS, strict=True)]
    return mom, qoq, yoy, t3m, z, sum(squashed) if n >= 2 else None


class TickAlerts(StatefulProcessor):
    """At most one alert a tick (J2), by event time: a tick closes when the watermark passes its end, whatever micro-batches its articles came in.

    State holds of each open tick the first `top` articles, and the titles
    alerted until the weekend's end, when all of it goes.
    """

    def __init__(self, top: int, tick_ms: int) -> None:
        self.top, self.tick = top, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "tick long, seq long", "title string, urgent boolean")
        self.seen = handle.getMapState("seen", "title string", "seq long")

    def _ticks(self) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for (tick, seq), (title, urgent) in self.open.iterator():
            out.setdefault(tick, []).append((seq, title, urgent))
        return {t: sorted(out[t]) for t in sorted(out)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for tick, part in batch.assign(tick=batch["at"] // 1000 // self.tick * self.tick).groupby("tick"):
                for r in part.nsmallest(self.top, "seq").itertuples():
                    self.open.updateValue((int(tick), int(r.seq)), (r.title, bool(r.urgent)))
                self.handle.registerTimer(int(tick) + self.tick)
        for tick, found in self._ticks().items():
            for seq, _, _ in found[self.top :]:
                self.open.removeKey((tick, seq))
        self.handle.registerTimer(self._end(key))
        yield from ()

    @staticmethod
    def _end(key: tuple) -> int:
        """Milliseconds of the Monday after the Saturday of the key."""
        return (pd.Timestamp(key[0]) - pd.Timestamp(0)).days * 86_400_000 + 2 * 86_400_000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        upto, out = timerValues.getCurrentWatermarkInMs(), []
        for tick, found in self._ticks().items():
            if tick + self.tick > upto:
                break
            for seq, title, urgent in found:
                if urgent and not self.seen.containsKey((title,)):
                    self.seen.updateValue((title,), (seq,))
                    out.append((key[0], seq, title))
                    break
            for seq, _, _ in found:
                self.open.removeKey((tick, seq))
        if out:
            yield pd.DataFrame(out, columns=["weekend", "seq", "title"])
        if self._end(key) <= upto:
            self.seen.clear()

    def close(self) -> None:
        pass


def device_violations(logins: DataFrame, late: str = "1 hour") -> DataFrame:
    """key, dev_type, login_id, device_id of logins (login_ts, login_id, key, dev_type, device_id) with another device than the first.

    Logins may come up to `late` after later ones: they are taken in the order of their times, those without a time not at all.
    """
    rows = logins.withWatermark("login_ts", late).where("login_ts IS NOT NULL").select("login_ts", "key", "dev_type", F.unix_micros("login_ts").alias("at"), F.coalesce("login_id", F.lit(-1)).alias("id"), "device_id")
    return rows.groupBy("key", "dev_type").transformWithStateInPandas(
        statefulProcessor=DeviceBinding(), outputStructType="key long, dev_type string, login_id long, device_id string", outputMode="Append", timeMode="EventTime"
    )


def live_history(obs: DataFrame, late: str = "1 hour") -> DataFrame:
    """series_id, at (microseconds), value, n, the horizons and score of each observation (series_id, date, id, value) once the watermark has passed it (C2 to C8); those without date or value are left out."""
    rows = obs.withWatermark("date", late).where("date IS NOT NULL AND value IS NOT NULL").select("date", "series_id", F.unix_micros("date").alias("at"), F.coalesce("id", F.lit(-1)).alias("id"), "value")
    return rows.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=Horizons(), outputStructType="series_id long, at long, value double, n long, mom double, qoq double, yoy double, t3m double, z double, score double", outputMode="Append", timeMode="EventTime"
    )


def tick_alerts(articles: DataFrame, late: str = "1 hour", top: int = 4, tick_ms: int = 3_600_000, words: list[str] = EMERGENCY) -> DataFrame:
    """weekend, seq, title: the alerts of first_of_ticks() from a stream of articles (ts, seq, title), which may come up to `late` after later ones."""
    rows = articles.withWatermark("ts", late).where(F.weekday("ts") >= 5)
    rows = rows.select("ts", F.date_sub(F.to_date("ts"), F.weekday("ts") - 5).alias("weekend"), F.unix_micros("ts").alias("at"), "seq", "title", F.coalesce(any_word(F.lower("title"), words), F.lit(False)).alias("urgent"))
    return rows.groupBy("weekend").transformWithStateInPandas(
        statefulProcessor=TickAlerts(top, tick_ms), outputStructType="weekend date, seq long, title string", outputMode="Append", timeMode="EventTime"
    )


def outbox_writer(recipients: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch (A6): each message (kind, message) of a micro-batch once for each recipient (chat_id), in a folder of the batch's number.

    A batch that is run again after a failure writes its folder anew, so that
    messages are neither lost nor sent twice; rows are keyed by batch, kind, message and recipient.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = outbox(batch.select("kind", "message").distinct(), recipients.select("chat_id").distinct())
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def read_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """chat_id, kind, message, batch of the batches that were written whole; a batch that was cut off is not there until it is run again."""
    shape = "chat_id string, kind string, message string, batch long"
    done = [p.removesuffix("/_SUCCESS") for p in found(spark, f"{folder}/batch=*/_SUCCESS")]
    return spark.read.schema(shape).option("basePath", folder).parquet(*done) if done else spark.createDataFrame([], shape)


def sessions(activity: DataFrame, gap: str = "5 days", late: str = "1 day") -> DataFrame:
    """Sessions of each device (J5): a gap of exactly `gap` still renews."""
    return activity.withWatermark("ts", late).groupBy("device_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def run_to_end(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that its sources have now, each micro-batch through a function; goes on from the checkpoint if there is one.

    State is kept by RocksDB, which processors with state of their own need, on disk beside a small cache.
    """
    conf = rows.sparkSession.conf
    name, before = "spark.sql.streaming.stateStore.providerClass", conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before)


def drained(rows: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream run to its end, each micro-batch a folder that a rerun of it writes anew."""
    spark, data = rows.sparkSession, f"{folder}/rows"
    run_to_end(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{data}/batch={number}"), f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{data}/batch=*")
