"""The driver's tables as the model's tables, on Spark and as CTEs for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import STOP_WORDS
from ..shared import fresh_path

#: Word lists that do occur in the tables' prose.
BULL, BEAR, URGENT = ["oil", "eau"], ["fed", "ing"], ["oil", "fed"]
ASSETS = [("Gold", ["oil", "fed"]), ("Oil", ["oil"]), ("USD", ["fed"]), ("EUR", ["eau"]), ("GBP", ["zzqx"]), ("JPY", ["tion"]), ("CAD", ["ment"]), ("AUD", ["sch"]), ("CHF", ["que"])]
EVENT_WORDS = [("E_USD", "USD", 3, 0, ["oil", "fed"]), ("E_CHF", "CHF", 5, 1, ["eau"]), ("E_OIL", "Oil", 5, 2, ["zzqx"]), ("E_NZD", "NZD", 0, 3, ["sch", "tion"])]
#: Event, series (nation), fallback, category, weight: series 99 and 98 have no data.
PRECURSORS = [("E_USD", 1, None, "growth", 0.6), ("E_USD", 99, 2, "labor_neg", 0.4), ("E_CHF", 3, None, "rate", 0.5), ("E_CHF", 99, 98, "rate", 0.5), ("E_OIL", 99, None, "growth", 1.0), ("E_NZD", 4, None, "inflation", 0.5)]
FALLBACKS = [("wti", 1, 99, 0.0), ("wti", 2, 5, 0.0), ("brent", 1, 6, 0.0), ("proxy", 1, 98, 0.0), ("proxy", 2, 6, -3.8)]
DRIVERS = [("Gold", "Neutral", "gold waits"), ("USD", "Neutral", "dollar waits"), ("USD", "Strong Bullish", "dollar leads"), ("Oil", "Moderate Bullish", "oil firms")]
TODAY, SALT, PREFIX = "2024-07-01", "pepper", "TIDE"


def scratch(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("ts").alias("date"), "value")


def raw_observations(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", ".").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("ts").alias("date"), value.alias("value"))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.col("c_nationkey").alias("series_id"), F.trunc("o_orderdate", "month").alias("date")).agg(total.alias("value"))


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    cat = F.array(*map(F.lit, ("inflation", "labor_pos", "labor_neg", "growth", "rate")))[n % 5]
    return table(spark, sf, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("currency"), F.col("n_name").alias("indicator"), n.alias("series_id"), cat.alias("cat"), (1 + 0.25 * (n % 4)).cast("double").alias("weight"), (n % 2 == 0).alias("is_key"), n.alias("key_ord"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.news import shorten

    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), shorten(F.col("text"), 110).alias("title"), F.col("text").alias("description"), F.col("source").alias("feed"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    day = lambda start, n: F.date_format(F.date_add(F.lit(start).cast("date"), (k % n).cast("int")), "yyyy-MM-dd")
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("client_name"),
        text("K", k).alias("key"),
        F.when(F.col("c_nationkey") % 3 == 0, " ").otherwise(text(" ", F.col("c_nationkey"))).alias("telegram_id"),
        F.lit("30").alias("duration"),
        day("2023-01-01", 365).alias("created_at"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Lifetime").otherwise(day("2024-01-01", 730)).alias("expires_at"),
        F.when(F.col("c_acctbal") < 0, "Revoked").otherwise("Active").alias("status"),
        F.when(k % 2 == 0, text("m", k)).otherwise("").alias("bound_mobile_id"),
        F.when(k % 3 == 0, text("p", k)).otherwise("").alias("bound_pc_id"),
        F.lit("").alias("bound_at"),
    )


def logins(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error", "click"), "Mobile").otherwise("PC")
    return table(spark, sf, "events").select(F.col("ts").alias("login_ts"), F.col("event_id").alias("login_id"), F.col("user_id").alias("key"), kind.alias("dev_type"), F.col("props").alias("device_id"))


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)


def values(name: str, columns: str, data: list[tuple]) -> str:
    """A CTE of literal rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in data) + ")"


OBS = "obs AS (SELECT user_id AS series_id, ts AS date, value FROM events)"
RAW = "raw AS (SELECT user_id AS series_id, ts AS date, CASE WHEN event_type = 'error' THEN '.' ELSE CAST(value AS VARCHAR) END AS value FROM events)"
MONTHLY = "monthly AS (SELECT c_nationkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
DIM = "dim AS (SELECT 'R' || n_regionkey AS currency, n_name AS indicator, n_nationkey AS series_id, ['inflation','labor_pos','labor_neg','growth','rate'][n_nationkey % 5 + 1] AS cat, CAST(1 + 0.25 * (n_nationkey % 4) AS DOUBLE) AS weight, n_nationkey % 2 = 0 AS is_key, n_nationkey AS key_ord FROM nation)"
ARTICLES = "articles AS (SELECT doc_id AS seq, CASE WHEN length(text) > 110 THEN substr(text, 1, 110) || '...' ELSE text END AS title, text AS description, source AS feed FROM documents)"
REGISTRY = """registry AS (SELECT c_name AS client_name, 'K' || c_custkey AS key, CASE WHEN c_nationkey % 3 = 0 THEN ' ' ELSE ' ' || c_nationkey END AS telegram_id, '30' AS duration,
 strftime(DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') AS created_at,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Lifetime' ELSE strftime(DATE '2024-01-01' + CAST(c_custkey % 730 AS INTEGER), '%Y-%m-%d') END AS expires_at,
 CASE WHEN c_acctbal < 0 THEN 'Revoked' ELSE 'Active' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey ELSE '' END AS bound_mobile_id,
 CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey ELSE '' END AS bound_pc_id, '' AS bound_at FROM customer)"""
LOGINS = "logins AS (SELECT ts AS login_ts, event_id AS login_id, user_id AS key, CASE WHEN event_type IN ('error','click') THEN 'Mobile' ELSE 'PC' END AS dev_type, props AS device_id FROM events)"
WORDS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains({literal(STOP_WORDS)}, x))))"
SETS = f"""kw AS (SELECT seq, {WORDS} AS words
 FROM articles WHERE length(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) >= 14),
 sets AS (SELECT words, min(seq) AS seq FROM kw WHERE len(words) > 0 GROUP BY words),
 pairs AS (SELECT a.seq AS a, b.seq AS b, len(list_intersect(a.words, b.words)) AS s, len(a.words) + len(b.words) AS t FROM sets a JOIN sets b ON a.seq < b.seq AND 20 * least(len(a.words), len(b.words)) >= 11 * greatest(len(a.words), len(b.words))),
 near AS (SELECT a, b, s / (t - s) AS jaccard FROM pairs WHERE 20 * s >= 11 * (t - s))"""


def metrics(source: str, name: str = "hist") -> str:
    """CTEs with n, the horizons and the unsigned score for every row of source."""
    pct = lambda a, b: f"({a} - {b}) / nullif(abs({b}), 0) * 100"
    return f"""{name}_w AS (SELECT series_id, date, value, row_number() OVER w AS n, lag(value, 1) OVER w AS v1, lag(value, 12) OVER w AS v12,
 avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a0, avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS a3,
 avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m12, stddev_pop(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS s12
 FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY date)),
 {name}_s AS (SELECT *, {pct("value", "v1")} AS step FROM {name}_w),
 {name}_h AS (SELECT series_id, date, value, n, CASE WHEN n >= 2 THEN coalesce(step, 0) END AS mom, CASE WHEN n >= 6 THEN coalesce({pct("a0", "a3")}, 0) END AS qoq, CASE WHEN n >= 13 THEN coalesce({pct("value", "v12")}, 0) END AS yoy,
 CASE WHEN n >= 4 THEN avg(step) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS t3m, CASE WHEN n >= 6 AND s12 > 0 THEN (value - m12) / s12 ELSE 0 END AS z FROM {name}_s),
 {name} AS (SELECT *, CASE WHEN n >= 2 THEN 0.30 * tanh(coalesce(mom, 0) / 0.5) + 0.25 * tanh(coalesce(qoq, 0) / 2.0) + 0.25 * tanh(coalesce(yoy, 0) / 5.0) + 0.10 * tanh(coalesce(t3m, 0) / 0.5) + 0.10 * tanh(z) END AS score FROM {name}_h),
 {name}_last AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1)"""


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def bias(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'Neutral' WHEN {x} >= 0.35 THEN 'Strong Bullish' WHEN {x} >= 0.15 THEN 'Moderate Bullish' WHEN {x} <= -0.35 THEN 'Strong Bearish' WHEN {x} <= -0.15 THEN 'Moderate Bearish' ELSE 'Neutral' END"


def hit(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {literal(w)})" for w in words) + ")"
