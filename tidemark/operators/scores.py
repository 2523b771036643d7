"""Blended scores, reports and event nowcasts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import bias_label, signed
from .news import news_points


#: Place of the yield's line in the report, after all assets.
LAST_LINE = 1_000_000


def asset_points(sentiment: DataFrame, assets: DataFrame) -> DataFrame:
    """asset, points for each asset and row of sentiment (E3): one row, or one for each window. The join without a key has the few assets on one side, which Spark broadcasts by their size."""
    keys = [c for c in sentiment.columns if c not in ("n", "delta")]
    return sentiment.crossJoin(assets.select("asset")).select(*keys, "asset", news_points(F.col("delta"), F.col("n"), F.col("asset")).alias("points"))


def currency_composite(macro: DataFrame, points: DataFrame) -> DataFrame:
    """Half macro, half news."""
    rows = macro.join(points, macro["currency"] == points["asset"])
    return rows.select("currency", "macro", "points", (0.5 * F.col("macro") + 0.5 * (F.col("points") / 0.5)).alias("composite"))


def gold_composite(yield_score: DataFrame, usd: DataFrame, points: DataFrame) -> DataFrame:
    """One row, null without yield data (E5). Inputs have at most a row each: has_data and score; macro; points."""
    score = 0.30 * -F.coalesce("score", F.lit(0.0)) + 0.20 * -F.coalesce("macro", F.lit(0.0)) + 0.50 * (F.col("points") / 0.5)
    return points.join(yield_score, how="left").join(usd, how="left").select(F.when(F.coalesce("has_data", F.lit(False)), score).alias("composite"))


def oil_composite(wti_score: DataFrame, points: DataFrame) -> DataFrame:
    """One row; without data the fixed score 0.12."""
    score = 0.5 * F.coalesce("score", F.lit(0.0)) + 0.5 * (F.col("points") / 0.5)
    return points.join(wti_score, how="left").select(F.when(F.coalesce("has_data", F.lit(False)), score).otherwise(0.12).alias("composite"))


def report_rows(scores: DataFrame, assets: DataFrame) -> DataFrame:
    """Every asset of the report in order; without a score Neutral and 0.00."""
    rows = assets.select("asset", "ord").join(scores, "asset", "left")
    return rows.select("asset", "ord", bias_label(F.col("score")).alias("strength"), F.when(F.col("score").isNull(), "0.00").otherwise(F.format_string("%+.2f", "score")).alias("score_text"), F.when(F.col("score").isNull(), "no data yet").otherwise("").alias("note"))


def driver_lookup(rows: DataFrame, drivers: DataFrame, default: str) -> DataFrame:
    """The text for (asset, strength), or the default."""
    return rows.join(drivers, ["asset", "strength"], "left").withColumn("driver", F.coalesce("driver", F.lit(default)))


def report(rows: DataFrame, wires: DataFrame, yields: DataFrame) -> DataFrame:
    """ord, line of the hourly report: asset, strength, score, driver or wire, and the newest real yield (date, value) last."""
    rows = rows.join(wires.select("asset", "wire"), "asset", "left")
    line = F.concat_ws(" | ", "asset", "strength", "score_text", F.coalesce(F.concat(F.lit("wire: "), F.col("wire")), F.col("driver")))
    newest = yields.agg(F.max_by("value", "date").alias("v"))
    shown = F.coalesce(F.format_string("%.2f%%", F.round("v", 2)), F.lit("N/A"))
    last = newest.select(F.lit(LAST_LINE).alias("ord"), F.concat(F.lit("US 10Y Real Yield: "), F.when(F.col("v").isNull(), "N/A").otherwise(shown)).alias("line"))
    return rows.select("ord", line.alias("line")).unionByName(last)


def report_text(lines: DataFrame) -> DataFrame:
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("report"))


def precursor_scores(metrics: DataFrame, dim: DataFrame) -> DataFrame:
    """code, precursor: weighted mean over precursors with data, their fallback if they have none.

    A series with one observation has no score and counts as 0 with its weight; an event without data has 0.
    """
    have = metrics.select("series_id", "score")
    own = have.select(F.col("series_id"), F.col("score").alias("own"), F.lit(True).alias("has"))
    other = have.select(F.col("series_id").alias("fallback_id"), F.col("score").alias("other"), F.lit(True).alias("has_other"))
    rows = dim.join(own, "series_id", "left").join(other, "fallback_id", "left")
    score = signed(F.coalesce(F.when(F.col("has"), F.col("own")).otherwise(F.col("other")), F.lit(0.0)), F.col("cat"))
    weight = F.when(F.col("has") | F.col("has_other"), F.col("weight"))
    total = F.sum(weight)
    return rows.groupBy("code").agg(F.coalesce(F.sum(score * weight) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("precursor"))


def nowcast_label(x: Column) -> Column:
    return F.when(x > 0.10, "higher").when(x < -0.10, "lower").otherwise("in line")


def event_nowcast(precursors: DataFrame, sentiment: DataFrame, events: DataFrame) -> DataFrame:
    """code, precursor, points, composite, confidence and directions for each event (E8, G2); sentiment by code, of its correlated articles."""
    rows = events.select("code", "currency").join(precursors, "code", "left").join(sentiment, "code", "left")
    points = F.coalesce(news_points(F.col("delta"), F.coalesce("n", F.lit(0)), F.col("currency")), F.lit(0.0))
    rows = rows.select("code", "currency", F.coalesce("precursor", F.lit(0.0)).alias("precursor"), points.alias("points"))
    composite = F.round(0.60 * F.col("precursor") + 0.40 * (F.col("points") / 0.5), 12)
    rows = rows.withColumn("composite", composite).withColumn("label", nowcast_label(F.col("composite")))
    confidence = F.least(F.lit(94), F.floor(F.round(62 + F.abs("composite") * 48, 9)).cast("int"))
    turn = lambda up, down: F.when(F.col("label") == "higher", up).when(F.col("label") == "lower", down).otherwise("range")
    return rows.select("*", confidence.alias("confidence"), turn("up", "down").alias("currency_turn"), turn("down", "up").alias("gold_turn"), turn("up", "down").alias("usd_turn"), turn("up", "down").alias("oil_turn"))


def upcoming(events: DataFrame, now: datetime.datetime) -> DataFrame:
    """events (code, template_ord, day_offset, any other columns) with date, days to go and countdown; weekends move to Monday; soonest first."""
    today = F.lit(now.date())
    others = [c for c in events.columns if c not in ("code", "template_ord", "day_offset")]
    rows = events.withColumn("d", F.date_add(today, F.col("day_offset")))
    rows = rows.withColumn("d", F.date_add("d", F.when(F.weekday("d") == 5, 2).when(F.weekday("d") == 6, 1).otherwise(0)))
    days = F.datediff("d", today)
    countdown = F.when(days == 0, "TODAY").when(days > 0, F.concat(F.lit("In "), days.cast("string"), F.lit(" Days"))).otherwise("Released")
    return rows.select("code", "template_ord", F.col("d").alias("event_date"), days.alias("days_away"), countdown.alias("countdown"), F.date_format("d", "EEEE, MMM dd").alias("shown"), *others).orderBy("days_away", "event_date", "template_ord")
