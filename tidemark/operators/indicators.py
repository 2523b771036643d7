"""Time-series indicators: one shuffle by series, frames of at most 13 rows, every date at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..dims import HORIZON_WEIGHTS, LABELS, MODERATE, STRONG
from ..shared import stored
from .ordering import running_sums


def by_series() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("date")


def clean_observations(raw: DataFrame) -> DataFrame:
    """Text values to doubles; what does not parse, or is NaN, goes (B1)."""
    value = F.expr("try_cast(trim(value) AS double)")
    return raw.withColumn("value", value).where(F.col("value").isNotNull() & ~F.isnan("value"))


def last_n(obs: DataFrame, n: int = 48) -> DataFrame:
    """The newest n rows of each series."""
    return obs.withColumn("rn", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("date").desc()))).where(F.col("rn") <= n)


def keep_latest(obs: DataFrame, ingest: str = "ingest") -> DataFrame:
    """Of the observations of a series with one date, that with the greatest `ingest` (a later revision); without the ingest column.

    The functions here count on dates that are unique within a series. This
    makes them so by a window on the same keys, so that windows which follow need no other shuffle or sort.
    """
    order = Window.partitionBy("series_id").orderBy("date", ingest)
    following = F.lead("date").over(order)
    return obs.withColumn("_last", following.isNull() | (following != F.col("date"))).where("_last").drop("_last", ingest)


def change(new: Column, old: Column) -> Column:
    """Percent change; null for a zero base."""
    return (new - old) / F.nullif(F.abs(old), F.lit(0.0)) * 100


def history(obs: DataFrame) -> DataFrame:
    """n, mom, qoq, yoy, t3m, z and the unsigned score for every observation.

    Lags count observations. A horizon without enough of them is null and adds
    nothing to the score; a zero base gives 0, and in t3m is left out. The score is null for n < 2.
    """
    series = by_series()
    avg = lambda a, b, c="value": F.avg(c).over(series.rowsBetween(a, b))
    v = F.col("value")
    out = obs.select(
        *obs.columns,
        F.row_number().over(series).alias("n"),
        F.lag("value", 1).over(series).alias("v1"),
        F.lag("value", 12).over(series).alias("v12"),
        avg(-2, 0).alias("a0"),
        avg(-5, -3).alias("a3"),
        avg(-11, 0).alias("m12"),
        F.stddev_pop("value").over(series.rowsBetween(-11, 0)).alias("s12"),
    ).withColumn("step", change(v, F.col("v1")))
    n, or0 = F.col("n"), lambda c: F.coalesce(c, F.lit(0.0))
    out = out.select(
        *obs.columns,
        "n",
        F.when(n >= 2, or0(F.col("step"))).alias("mom"),
        F.when(n >= 6, or0(change(F.col("a0"), F.col("a3")))).alias("qoq"),
        F.when(n >= 13, or0(change(v, F.col("v12")))).alias("yoy"),
        F.when(n >= 4, avg(-2, 0, "step")).alias("t3m"),
        F.when((n >= 6) & (F.col("s12") > 0), (v - F.col("m12")) / F.col("s12")).otherwise(0.0).alias("z"),
    )
    parts = [weight * F.tanh(or0(F.col(c)) / scale) for c, (weight, scale) in zip(("mom", "qoq", "yoy", "t3m", "z"), HORIZON_WEIGHTS, strict=True)]
    score = reduce(lambda a, b: a + b, parts)
    return out.withColumn("score", F.when(n >= 2, score))


def signed(score: Column, cat: Column) -> Column:
    return F.when(cat == "labor_neg", -score).otherwise(score)


def latest(obs: DataFrame) -> DataFrame:
    """The newest row of history() for each series (C8): partial aggregation, no second sort."""
    rows = history(obs)
    newest = rows.groupBy("series_id").agg(F.max_by(F.struct(*rows.columns), "date").alias("r"))
    return newest.select("r.*")


def sparkline(obs: DataFrame, width: float = 80, height: float = 32, points: int = 20, pos_good: bool = True) -> DataFrame:
    """series_id, i, x, y and good of the last points, scaled to a box; series with one point have none."""
    rows = last_n(obs, points)
    w = Window.partitionBy("series_id")
    rows = rows.select("series_id", "value", "rn", F.count("*").over(w).alias("m"), F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"), F.max_by("value", "rn").over(w).alias("first"), F.min_by("value", "rn").over(w).alias("last"))
    span = F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    i = F.col("m") - F.col("rn")
    return rows.where("m >= 2").select("series_id", i.cast("int").alias("i"), (i / (F.col("m") - 1) * width).alias("x"), (height - (F.col("value") - F.col("lo")) / span * height).alias("y"), ((F.col("last") > F.col("first")) == F.lit(pos_good)).alias("good"))


def bias_label(score: Column) -> Column:
    """Strong and moderate bands; null and NaN are Neutral (G1)."""
    bull, mild_bull, bear, mild_bear, neutral = LABELS
    return F.when(score.isNull() | F.isnan(score), neutral).when(score >= STRONG, bull).when(score >= MODERATE, mild_bull).when(score <= -STRONG, bear).when(score <= -MODERATE, mild_bear).otherwise(neutral)


def indicator_table(metrics: DataFrame, dim: DataFrame) -> DataFrame:
    """Metrics of each indicator of each currency; series without data drop out (D1). dim is small by nature: Spark broadcasts it by its size."""
    rows = metrics.join(dim, "series_id").withColumn("score", signed(F.col("score"), F.col("cat")))
    return rows.withColumn("bias", bias_label(F.col("score")))


def macro_score(rows: DataFrame) -> DataFrame:
    """Weighted mean of the scores there are, by currency."""
    rows = rows.where(F.col("score").isNotNull())
    return rows.groupBy("currency").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("macro"))


def key_cards(rows: DataFrame) -> DataFrame:
    """Key indicators of each currency in their order, with the colour flag."""
    good = (F.col("mom") > 0) == (F.col("cat") != "labor_neg")
    return rows.where("is_key").select("currency", "key_ord", "indicator", "value", "mom", good.alias("good"))


def composite_history(obs: DataFrame, dim: DataFrame) -> DataFrame:
    """currency, date, macro: each series' score carried forward to all dates of its currency (C11).

    A sweep over dates: a score counts from its date on, so it adds its
    difference from the series' score before, and its weight if it is the first.
    Differences are summed by date, then along the dates of a currency: rows
    follow the observations, not dates times series. The running sums are of
    ranges of dates, each begun with the sums of those before it.
    """
    series = Window.partitionBy("currency", "series_id").orderBy("date")
    rows = history(obs).join(dim, "series_id").select("currency", "series_id", "weight", "date", signed(F.col("score"), F.col("cat")).alias("score"))
    before = F.lag("score").over(series)
    there, none = F.col("score").isNotNull(), F.lit(0.0)
    # A series' first date has no score yet, but is a date of its currency.
    up = F.when(there, F.col("weight") * (F.col("score") - F.coalesce(before, none))).otherwise(none)
    steps = rows.select("currency", "date", up.alias("up"), F.when(there & before.isNull(), F.col("weight")).otherwise(none).alias("more"))
    by_date = stored(steps.groupBy("currency", "date").agg(F.sum("up").alias("up"), F.sum("more").alias("more")), "sweep")
    sums = running_sums(by_date, "currency", "date", ["up", "more"])
    return sums.where("more > 0").select("currency", "date", (F.col("up") / F.col("more")).alias("macro"))


def series_fallback(obs: DataFrame, dim: DataFrame) -> DataFrame:
    """For each role the observations of its first series that has any, shifted by its offset."""
    ranked = obs.join(dim, "series_id")
    first = ranked.groupBy("role").agg(F.min("rank").alias("rank"))
    return ranked.join(first, ["role", "rank"]).withColumn("value", F.col("value") + F.col("offset")).drop("offset", "rank")


def real_yield(obs: DataFrame, real: str, nominal: str, breakeven: str, cut: int = 60, keep: int = 36) -> DataFrame:
    """date, value of the real series or, if it has no data at all, nominal less breakeven on common dates."""
    rows = last_n(obs.where(F.col("series_id").isin(real, nominal, breakeven)), cut)
    two = rows.where(F.col("series_id").isin(nominal, breakeven)).groupBy("date").agg(*(F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(n) for s, n in ((nominal, "a"), (breakeven, "b"))))
    two = two.where("a is not null and b is not null").select("date", (F.col("a") - F.col("b")).alias("value"), F.lit(2).alias("rank"))
    one = rows.where(F.col("series_id") == real).select("date", "value", F.lit(1).alias("rank"))
    both = one.unionByName(two)
    both = both.join(both.agg(F.min("rank").alias("rank")), "rank")
    return both.select("date", "value").orderBy(F.col("date").desc()).limit(keep)


def last_spread(obs: DataFrame, a: str, b: str) -> DataFrame:
    """Last value of a less that of b, each on its own last date."""
    one = lambda s: F.max_by(F.when(F.col("series_id") == s, F.col("value")), F.when(F.col("series_id") == s, F.col("date")))
    return obs.where(F.col("series_id").isin(a, b)).agg((one(a) - one(b)).alias("spread"))


def aligned_spread(obs: DataFrame, a: str, b: str) -> DataFrame:
    rows = obs.where(F.col("series_id").isin(a, b)).groupBy("date").agg(*(F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(n) for s, n in ((a, "a"), (b, "b"))))
    return rows.where("a is not null and b is not null").select("date", (F.col("a") - F.col("b")).alias("spread"))
