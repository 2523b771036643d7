"""Queries on observations: cleaning, horizons, scores, fallbacks, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import news as N
from ..operators import scores as S
from ..shared import stored
from ..sources import readers
from . import model as M
from .model import ARTICLES, DIM, MONTHLY, OBS, RAW, bias, hit, metrics, r6

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(name: str, to: str | None = None):  # noqa: ANN201
    return (F.round(name, 6) + 0.0).alias(to or name)


#: The tables' times have no zone: count from the epoch without one.
MICROS, SQL_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', date)", "epoch_us(date) AS micros"


def micros():  # noqa: ANN201
    return F.expr(MICROS).alias("micros")



@query(f"WITH {RAW} SELECT series_id, {SQL_MICROS}, {r6('CAST(value AS DOUBLE)')} AS value FROM raw WHERE value <> '.'")
def read_observations(spark: SparkSession, sf: str) -> DataFrame:
    """A1: events written as JSON payloads of one observation, read by the reader, then cleaned."""
    path = M.scratch(spark, "observations")
    raw = M.raw_observations(spark, sf)
    raw.select(F.col("series_id").cast("string").alias("series_id"), F.array(F.struct(F.expr(MICROS).cast("string").alias("date"), "value")).alias("observations")).write.json(path)
    rows = I.clean_observations(readers.read_observations(spark, path))
    return rows.select(F.col("series_id").cast("long").alias("series_id"), F.col("date").cast("long").alias("micros"), r("value"))


@query(f"WITH {RAW} SELECT series_id, {SQL_MICROS}, {r6('CAST(value AS DOUBLE)')} AS value FROM raw WHERE value <> '.'")
def clean_observations(spark: SparkSession, sf: str) -> DataFrame:
    return I.clean_observations(M.raw_observations(spark, sf)).select("series_id", micros(), r("value"))


@query(f"WITH {OBS} SELECT series_id, {SQL_MICROS}, {r6('value')} AS value FROM obs QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 48")
def last_n_observations(spark: SparkSession, sf: str) -> DataFrame:
    return I.last_n(M.observations(spark, sf)).select("series_id", micros(), r("value"))


def _one(column: str):  # noqa: ANN202
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return I.history(M.observations(spark, sf)).select("series_id", micros(), r(column))

    return f, f"WITH {OBS}, {metrics('obs')} SELECT series_id, {SQL_MICROS}, {r6(column)} AS {column} FROM hist"


for _name, _column in (("momentum_mom", "mom"), ("momentum_qoq", "qoq"), ("momentum_yoy", "yoy"), ("trend_t3m", "t3m"), ("zscore_12", "z"), ("mtf_score", "score")):
    QUERIES[_name], SQL[_name] = _one(_column)

ALL = ("mom", "qoq", "yoy", "t3m", "z", "score")


@query(f"WITH {OBS}, {metrics('obs')} SELECT series_id, {SQL_MICROS}, {r6('value')} AS value, {', '.join(f'{r6(c)} AS {c}' for c in ALL)} FROM hist")
def mtf_history(spark: SparkSession, sf: str) -> DataFrame:
    return I.history(M.observations(spark, sf)).select("series_id", micros(), r("value"), *map(r, ALL))


@query(f"WITH {OBS}, {metrics('obs')} SELECT series_id, {SQL_MICROS}, {r6('value')} AS value, {', '.join(f'{r6(c)} AS {c}' for c in ALL)} FROM hist_last")
def mtf_latest(spark: SparkSession, sf: str) -> DataFrame:
    return I.latest(M.observations(spark, sf)).select("series_id", micros(), r("value"), *map(r, ALL))


DAILY = "daily AS (SELECT user_id AS series_id, CAST(ts AS DATE) AS date, event_id AS ingest, value FROM events), revised AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY ingest DESC) = 1)"


@query(f"WITH {DAILY}, {metrics('revised')} SELECT series_id, date, n, {r6('value')} AS value, {', '.join(f'{r6(c)} AS {c}' for c in ALL)} FROM hist")
def revised_history(spark: SparkSession, sf: str) -> DataFrame:
    """C2 to C9 of a series whose days come several times: the last to come in counts."""
    daily = M.table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.to_date("ts").alias("date"), F.col("event_id").alias("ingest"), "value")
    return I.history(I.keep_latest(daily)).select("series_id", "date", "n", r("value"), *map(r, ALL))


@query(f"WITH {OBS}, {metrics('obs')} SELECT series_id, {SQL_MICROS}, {r6('value')} AS value, n, {', '.join(f'{r6(c)} AS {c}' for c in ALL)} FROM hist")
def live_history(spark: SparkSession, sf: str) -> DataFrame:
    """C2 to C8 as a stream over the events, in any order within a batch."""
    from ..streaming import streams as X
    from .feeds import _stream

    obs = M.table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("date"), F.col("event_id").alias("id"), "value")
    rows = X.drained(X.live_history(_stream(spark, obs, "date", "observations")), M.scratch(spark, "history"))
    return rows.select("series_id", F.col("at").alias("micros"), r("value"), F.col("n").cast("int").alias("n"), *map(r, ALL))


@query(f"""WITH {OBS}, l AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM obs QUALIFY rn <= 20),
 b AS (SELECT *, count(*) OVER w AS m, min(value) OVER w AS lo, max(value) OVER w AS hi, arg_max(value, rn) OVER w AS f, arg_min(value, rn) OVER w AS l FROM l WINDOW w AS (PARTITION BY series_id))
 SELECT series_id, CAST(m - rn AS INTEGER) AS i, round((m - rn) / (m - 1) * 80.0, 4) + 0.0 AS x, round(32.0 - (value - lo) / coalesce(nullif(hi - lo, 0), 1) * 32.0, 4) + 0.0 AS y, l > f AS good FROM b WHERE m >= 2""")
def sparkline_points(spark: SparkSession, sf: str) -> DataFrame:
    return I.sparkline(M.observations(spark, sf)).select("series_id", "i", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"), "good")


SIGNED = "CASE WHEN cat = 'labor_neg' THEN -score ELSE score END"
TABLE = f"{MONTHLY}, {DIM}, {metrics('monthly', 'm')}, tab AS (SELECT dim.*, m_last.date, value, mom, qoq, yoy, t3m, z, n, {SIGNED} AS score FROM m_last JOIN dim USING (series_id)), macro AS (SELECT currency, sum(score * weight) / sum(weight) AS macro FROM tab WHERE score IS NOT NULL GROUP BY currency)"


def _table(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    return I.indicator_table(I.latest(obs or M.monthly(spark, sf)), M.dimension(spark, sf))


@query(f"WITH {TABLE} SELECT currency, indicator, cat, {r6('weight')} AS weight, {r6('value')} AS value, {r6('mom')} AS mom, {r6('qoq')} AS qoq, {r6('yoy')} AS yoy, {bias('score')} AS bias FROM tab")
def indicator_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf).select("currency", "indicator", "cat", r("weight"), r("value"), r("mom"), r("qoq"), r("yoy"), "bias")


@query(f"WITH {TABLE} SELECT series_id, {bias('score')} AS bias FROM tab")
def bias_label(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf).select("series_id", I.bias_label(F.col("score")).alias("bias"))


@query(f"WITH {TABLE} SELECT currency, {r6('macro')} AS macro FROM macro")
def currency_macro_score(spark: SparkSession, sf: str) -> DataFrame:
    return I.macro_score(_table(spark, sf)).select("currency", r("macro"))


@query(f"WITH {TABLE} SELECT currency, key_ord, indicator, {r6('value')} AS value, {r6('mom')} AS mom, (mom > 0) = (cat <> 'labor_neg') AS good FROM tab WHERE is_key")
def key_indicator_cards(spark: SparkSession, sf: str) -> DataFrame:
    return I.key_cards(_table(spark, sf)).select("currency", "key_ord", "indicator", r("value"), r("mom"), "good")


@query(f"""WITH {MONTHLY}, {DIM}, {metrics('monthly', 'm')}, s AS (SELECT currency, series_id, weight, date, {SIGNED} AS score FROM m JOIN dim USING (series_id)),
 spine AS (SELECT DISTINCT d.currency, d.series_id, d.weight, s.date FROM s JOIN dim d ON d.currency = s.currency),
 filled AS (SELECT currency, date, weight, last_value(score IGNORE NULLS) OVER (PARTITION BY currency, series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS score FROM spine LEFT JOIN s USING (currency, series_id, weight, date))
 SELECT currency, date, {r6('sum(score * weight) / sum(weight)')} AS macro FROM filled WHERE score IS NOT NULL GROUP BY currency, date""")
def composite_history(spark: SparkSession, sf: str) -> DataFrame:
    return I.composite_history(M.monthly(spark, sf), M.dimension(spark, sf)).select("currency", "date", r("macro"))


YIELDS = """newest AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM monthly), cut AS (SELECT * FROM newest WHERE rn <= 60),
 two AS (SELECT a.date, a.value - b.value AS value FROM cut a JOIN cut b ON a.date = b.date AND a.series_id = 7 AND b.series_id = 8),
 ry AS (SELECT date, value FROM cut WHERE series_id = 99 UNION ALL SELECT date, value FROM two WHERE NOT EXISTS (SELECT 1 FROM cut WHERE series_id = 99) ORDER BY date DESC LIMIT 36)"""


def _yields(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    return I.real_yield((obs or M.monthly(spark, sf)).withColumn("series_id", F.col("series_id").cast("string")), "99", "7", "8")


@query(f"WITH {MONTHLY}, {YIELDS} SELECT date, {r6('value')} AS value FROM ry")
def real_yield(spark: SparkSession, sf: str) -> DataFrame:
    return _yields(spark, sf).select("date", r("value"))


FALL = M.values("fb", "role, rank, series_id, off", M.FALLBACKS)
PICKED = f"{FALL}, ranked AS (SELECT role, rank, series_id, date, value + off AS value FROM monthly JOIN fb USING (series_id)), picked AS (SELECT * FROM ranked QUALIFY rank = min(rank) OVER (PARTITION BY role))"


def _fallback(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    dim = M.rows(spark, M.FALLBACKS, "role string, rank int, series_id int, offset double")
    return I.series_fallback(obs or M.monthly(spark, sf), dim)


@query(f"WITH {MONTHLY}, {PICKED} SELECT role, series_id, date, {r6('value')} AS value FROM picked WHERE role <> 'proxy'")
def series_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _fallback(spark, sf).where("role <> 'proxy'").select("role", "series_id", "date", r("value"))


@query(f"WITH {MONTHLY}, {PICKED} SELECT date, {r6('value')} AS value FROM picked WHERE role = 'proxy'")
def oil_proxy(spark: SparkSession, sf: str) -> DataFrame:
    return _fallback(spark, sf).where("role = 'proxy'").select("date", r("value"))


@query(f"WITH {MONTHLY} SELECT a.date, {r6('a.value - b.value')} AS spread, (SELECT {r6('arg_max(value, date) FILTER (WHERE series_id = 6) - arg_max(value, date) FILTER (WHERE series_id = 5)')} FROM monthly) AS last_spread FROM monthly a JOIN monthly b ON a.date = b.date AND a.series_id = 6 AND b.series_id = 5")
def brent_wti_spread(spark: SparkSession, sf: str) -> DataFrame:
    obs = M.monthly(spark, sf)
    # The join without a key adds one row, the last spread, to each.
    return I.aligned_spread(obs, 6, 5).crossJoin(I.last_spread(obs, 6, 5).withColumnRenamed("spread", "last_spread")).select("date", r("spread"), r("last_spread"))


# Sentiment and blends.
NEWS_TEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"
SENT = f"{ARTICLES}, sent AS (SELECT count(*) AS n, 0.04 * coalesce(sum(CAST({hit(NEWS_TEXT, M.BULL)} AS INTEGER)) - sum(CAST({hit(NEWS_TEXT, M.BEAR)} AS INTEGER)), 0) AS delta FROM articles)"
POINT = "CASE WHEN n = 0 THEN 0.0 ELSE greatest(-0.5, least(0.5, CASE WHEN asset IN ('Gold','CHF') THEN 0.05 - delta WHEN asset = 'Oil' THEN delta + 0.08 ELSE delta END)) END"
ASSET_ROWS = [(a,) for a in ("USD", "EUR", "GBP", "CAD", "JPY", "AUD", "NZD", "CHF", "Gold", "Oil", "R0", "R1", "R2", "R3", "R4")]
POINTS = f"{SENT}, {M.values('assets', 'asset', ASSET_ROWS)}, points AS (SELECT asset, {POINT} AS points FROM assets CROSS JOIN sent)"


def _sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return N.sentiment(M.articles(spark, sf), None, M.BULL, M.BEAR)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return S.asset_points(_sentiment(spark, sf), M.rows(spark, ASSET_ROWS, "asset string"))


@query(f"WITH {SENT} SELECT n, {r6('delta')} AS delta FROM sent")
def sentiment_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _sentiment(spark, sf).select("n", r("delta"))


@query(f"WITH {POINTS} SELECT asset, {r6('points')} AS points FROM points")
def asset_news_points(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("asset", r("points"))


COMP = "0.5 * macro + 0.5 * (points / 0.5)"


@query(f"WITH {TABLE}, {POINTS} SELECT currency, {r6('macro')} AS macro, {r6('points')} AS points, {r6(COMP)} AS composite FROM macro JOIN points ON asset = currency")
def currency_composite(spark: SparkSession, sf: str) -> DataFrame:
    return S.currency_composite(I.macro_score(_table(spark, sf)), _points(spark, sf)).select("currency", r("macro"), r("points"), r("composite"))


GOLD = f"yobs AS (SELECT 'ry' AS series_id, date, value FROM ry), {metrics('yobs', 'y')}, gold AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM ry) THEN 0.30 * -coalesce((SELECT score FROM y_last), 0) + 0.20 * -coalesce((SELECT macro FROM macro WHERE currency = 'R0'), 0) + 0.50 * (points / 0.5) END AS composite FROM points WHERE asset = 'Gold')"
OIL = f"wobs AS (SELECT 'wti' AS series_id, date, value FROM picked WHERE role = 'wti'), {metrics('wobs', 'wt')}, oil AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM wobs) THEN 0.5 * coalesce((SELECT score FROM wt_last), 0) + 0.5 * (points / 0.5) ELSE 0.12 END AS composite FROM points WHERE asset = 'Oil')"


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    y = I.latest(_yields(spark, sf).withColumn("series_id", F.lit("ry"))).select("score", F.lit(True).alias("has_data"))
    usd = I.macro_score(_table(spark, sf)).where("currency = 'R0'").select("macro")
    return S.gold_composite(y, usd, _points(spark, sf).where("asset = 'Gold'"))


def _oil(spark: SparkSession, sf: str) -> DataFrame:
    w = _fallback(spark, sf).where("role = 'wti'").select(F.lit("wti").alias("series_id"), "date", "value")
    return S.oil_composite(I.latest(w).select("score", F.lit(True).alias("has_data")), _points(spark, sf).where("asset = 'Oil'"))


@query(f"WITH {TABLE}, {POINTS}, {YIELDS}, {GOLD} SELECT {r6('composite')} AS composite FROM gold")
def gold_composite(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf).select(r("composite"))


@query(f"WITH {MONTHLY}, {POINTS}, {PICKED}, {OIL} SELECT {r6('composite')} AS composite FROM oil")
def oil_composite(spark: SparkSession, sf: str) -> DataFrame:
    return _oil(spark, sf).select(r("composite"))


PRE = f"""{M.values("pre", "code, series_id, fallback_id, cat, weight", M.PRECURSORS)}, prs AS (SELECT code, cat, CASE WHEN o.series_id IS NOT NULL THEN o.score ELSE f.score END AS score, CASE WHEN o.series_id IS NOT NULL OR f.series_id IS NOT NULL THEN weight END AS weight
 FROM pre LEFT JOIN m_last o ON o.series_id = pre.series_id LEFT JOIN m_last f ON f.series_id = pre.fallback_id),
 prec AS (SELECT code, coalesce(sum(CASE WHEN cat = 'labor_neg' THEN -coalesce(score, 0) ELSE coalesce(score, 0) END * weight) / nullif(sum(weight), 0), 0) AS precursor FROM prs GROUP BY code)"""


def _precursors(spark: SparkSession, sf: str) -> DataFrame:
    dim = M.rows(spark, M.PRECURSORS, "code string, series_id int, fallback_id int, cat string, weight double")
    return S.precursor_scores(I.latest(M.monthly(spark, sf)), dim)


@query(f"WITH {MONTHLY}, {metrics('monthly', 'm')}, {PRE} SELECT code, {r6('precursor')} AS precursor FROM prec")
def precursor_score(spark: SparkSession, sf: str) -> DataFrame:
    return _precursors(spark, sf).select("code", r("precursor"))


EV = f"{M.values('ev', 'code, currency, day_offset, template_ord, keywords', M.EVENT_WORDS)}, corr AS (SELECT code, seq, title, description FROM articles JOIN ev ON len(list_filter(keywords, lambda w: contains({NEWS_TEXT}, w))) > 0)"
NOW = f"""esent AS (SELECT code, count(*) AS n, 0.04 * coalesce(sum(CAST({hit(NEWS_TEXT, M.BULL)} AS INTEGER)) - sum(CAST({hit(NEWS_TEXT, M.BEAR)} AS INTEGER)), 0) AS delta FROM corr GROUP BY code),
 j AS (SELECT ev.code, currency AS asset, coalesce(precursor, 0) AS precursor, coalesce(n, 0) AS n, delta FROM ev LEFT JOIN prec USING (code) LEFT JOIN esent USING (code)),
 p AS (SELECT code, asset AS currency, precursor, coalesce({POINT}, 0) AS points FROM j), c AS (SELECT *, round(0.60 * precursor + 0.40 * (points / 0.5), 12) AS composite FROM p),
 nowc AS (SELECT *, CASE WHEN composite > 0.10 THEN 'higher' WHEN composite < -0.10 THEN 'lower' ELSE 'in line' END AS label, least(94, CAST(floor(round(62 + abs(composite) * 48, 9)) AS INTEGER)) AS confidence FROM c)"""


def news_text():  # noqa: ANN201
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))


def _events(spark: SparkSession) -> DataFrame:
    return M.rows(spark, M.EVENT_WORDS, "code string, currency string, day_offset int, template_ord int, keywords array<string>")


def _nowcast(spark: SparkSession, sf: str) -> DataFrame:
    events, articles = _events(spark), M.articles(spark, sf)
    lower = articles.withColumn("t", F.lower(news_text()))
    hits = lower.join(events.select("code", "keywords"), F.exists("keywords", lambda w: F.contains(F.col("t"), w)))
    return S.event_nowcast(_precursors(spark, sf), N.sentiment(hits, ["code"], M.BULL, M.BEAR), events)


@query(f"WITH {ARTICLES}, {EV} SELECT code, seq, row_number() OVER (PARTITION BY code ORDER BY seq) <= 3 AS top FROM corr")
def correlated_articles(spark: SparkSession, sf: str) -> DataFrame:
    hits = N.match_events(M.articles(spark, sf), _events(spark), news_text())
    top = N.top_per_key(hits, "code", "seq", 3).select("code", "seq", F.lit(True).alias("top"))
    return hits.join(top, ["code", "seq"], "left").withColumn("top", F.coalesce("top", F.lit(False)))


@query("""WITH w AS (SELECT item_id AS code, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')) AS keywords FROM benchmark)
 SELECT code, count(*) AS n, min(doc_id) AS first FROM documents JOIN w ON len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0 GROUP BY code""")
def correlated_by_long_lists(spark: SparkSession, sf: str) -> DataFrame:
    """D7 for long lists: benchmark items as events, with all their longer words."""
    items = M.table(spark, sf, "benchmark")
    events = items.select(F.col("item_id").alias("code"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("keywords"))
    hits = N.match_words(M.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text"), events, F.col("text"))
    return hits.groupBy("code").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


NOWCAST = f"{MONTHLY}, {metrics('monthly', 'm')}, {PRE}, {ARTICLES}, {EV}, {NOW}"


def turn(up: str, down: str) -> str:
    return f"CASE label WHEN 'higher' THEN '{up}' WHEN 'lower' THEN '{down}' ELSE 'range' END"


@query(f"WITH {NOWCAST} SELECT code, currency, {r6('precursor')} AS precursor, {r6('points')} AS points, {r6('composite')} AS composite, label, confidence, {turn('up', 'down')} AS currency_turn, {turn('down', 'up')} AS gold_turn, {turn('up', 'down')} AS usd_turn, {turn('up', 'down')} AS oil_turn FROM nowc")
def event_nowcast(spark: SparkSession, sf: str) -> DataFrame:
    return _nowcast(spark, sf).select("code", "currency", r("precursor"), r("points"), r("composite"), "label", "confidence", "currency_turn", "gold_turn", "usd_turn", "oil_turn")


@query(f"WITH {NOWCAST} SELECT code, label FROM nowc")
def nowcast_label(spark: SparkSession, sf: str) -> DataFrame:
    return _nowcast(spark, sf).select("code", "label")


@query(f"WITH {NOWCAST} SELECT count(*) AS events, {r6('avg(confidence)')} AS confidence FROM nowc")
def forecast_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _nowcast(spark, sf).agg(F.count("*").alias("events"), (F.round(F.avg("confidence"), 6) + 0.0).alias("confidence"))


MATRIX = ", ".join(f"{r6(c)} AS {c}" for c in ("value", "mom", "qoq", "yoy", "score"))


@query(f"WITH {TABLE}, {YIELDS}, yobs AS (SELECT 'real yield' AS series_id, date, value FROM ry), {metrics('yobs', 'y')}, u AS (SELECT series_id, value, mom, qoq, yoy, -score AS score FROM y_last UNION ALL SELECT 'usd pressure', macro, NULL, NULL, NULL, macro FROM macro WHERE currency = 'R0') SELECT series_id AS driver, {MATRIX}, {bias('score')} AS bias FROM u")
def gold_matrix(spark: SparkSession, sf: str) -> DataFrame:
    y = I.latest(_yields(spark, sf).withColumn("series_id", F.lit("real yield"))).select(F.col("series_id").alias("driver"), "value", "mom", "qoq", "yoy", (-F.col("score")).alias("score"))
    none = F.lit(None).cast("double")
    usd = I.macro_score(_table(spark, sf)).where("currency = 'R0'").select(F.lit("usd pressure").alias("driver"), F.col("macro").alias("value"), none.alias("mom"), none.alias("qoq"), none.alias("yoy"), F.col("macro").alias("score"))
    rows = y.unionByName(usd)
    return rows.select("driver", *(r(c) for c in ("value", "mom", "qoq", "yoy", "score")), I.bias_label(F.col("score")).alias("bias"))


@query(f"WITH {MONTHLY}, {PICKED}, o AS (SELECT role AS series_id, date, value FROM picked WHERE role IN ('wti', 'brent') UNION ALL SELECT 'spread', a.date, a.value - b.value FROM monthly a JOIN monthly b ON a.date = b.date AND a.series_id = 6 AND b.series_id = 5), {metrics('o', 'oo')} SELECT series_id AS driver, {MATRIX}, {bias('score')} AS bias FROM oo_last")
def oil_matrix(spark: SparkSession, sf: str) -> DataFrame:
    picked = _fallback(spark, sf).where("role <> 'proxy'").select(F.col("role").alias("series_id"), "date", "value")
    spread = I.aligned_spread(M.monthly(spark, sf), 6, 5).select(F.lit("spread").alias("series_id"), "date", F.col("spread").alias("value"))
    rows = I.latest(picked.unionByName(spread))
    return rows.select(F.col("series_id").alias("driver"), *(r(c) for c in ("value", "mom", "qoq", "yoy", "score")), I.bias_label(F.col("score")).alias("bias"))


# The hourly report: nine assets; AUD has no indicators.
MAP = [("USD", "R0"), ("EUR", "R1"), ("GBP", "R2"), ("JPY", "R3"), ("CAD", "R4"), ("CHF", "R4")]
WIRE_ROWS = [(a, k, w) for k, (a, w) in enumerate(M.ASSETS)]
#: A score of 12 digits with its sign, rounded to two of them, ties away from zero; like Python's and Java's formats, one that rounds to zero keeps its sign.
SCORE_TEXT = "CASE WHEN score IS NULL THEN '0.00' ELSE (CASE WHEN CAST(score AS DECIMAL(18,12)) < 0 THEN '-' ELSE '+' END) || printf('%.2f', CAST(round(abs(CAST(score AS DECIMAL(18,12))), 2) AS DOUBLE)) END"
SCORES = f"{TABLE}, {POINTS}, {YIELDS}, {GOLD}, {PICKED}, {OIL}, {M.values('map', 'asset, currency', MAP)}, {M.values('wa', 'asset, ord, keywords', WIRE_ROWS)}, {M.values('dr', 'asset, strength, driver', M.DRIVERS)}, " + (
    "sc AS (SELECT asset, 0.5 * macro + 0.5 * (points / 0.5) AS score FROM map JOIN macro USING (currency) JOIN points USING (asset) UNION ALL SELECT 'Gold', composite FROM gold UNION ALL SELECT 'Oil', composite FROM oil), "
    f"rep AS (SELECT asset, ord, {bias('round(score, 12)')} AS strength, {SCORE_TEXT} AS score_text, CASE WHEN score IS NULL THEN 'no data yet' ELSE '' END AS note FROM wa LEFT JOIN sc USING (asset)), "
    "drv AS (SELECT rep.*, coalesce(driver, 'mixed signals') AS driver FROM rep LEFT JOIN dr USING (asset, strength)), "
    "wh AS (SELECT asset, seq, title FROM articles JOIN wa ON len(list_filter(keywords, lambda w: contains(lower(title), w))) > 0), "
    "wire AS (SELECT asset, min(seq) AS seq, arg_min(CASE WHEN length(title) > 65 THEN substr(title, 1, 65) || '...' ELSE title END, seq) AS wire FROM wh GROUP BY asset)"
)


def _assets(spark: SparkSession) -> DataFrame:
    return M.rows(spark, WIRE_ROWS, "asset string, ord int, keywords array<string>")


def _roles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The newest metrics of all that the report needs, from one pass: the monthly series, the real yield (ry) and the oil price (wti); and the real yield."""
    obs = stored(M.monthly(spark, sf), "monthly")
    yields = stored(_yields(spark, sf, obs).select("date", "value"), "yields")
    wti = _fallback(spark, sf, obs).where("role = 'wti'")
    each = obs.select(F.col("series_id").cast("string").alias("series_id"), "date", "value")
    for name, rows in (("ry", yields), ("wti", wti)):
        each = each.unionByName(rows.select(F.lit(name).alias("series_id"), "date", "value"))
    return stored(I.latest(each), "newest"), yields


def _scores(spark: SparkSession, sf: str, newest: DataFrame) -> DataFrame:
    """asset, score."""
    points = stored(_points(spark, sf), "points")
    dim = M.dimension(spark, sf).withColumn("series_id", F.col("series_id").cast("string"))
    macro = stored(I.macro_score(I.indicator_table(newest, dim)), "macro")
    mapped = M.rows(spark, MAP, "asset string, currency string").join(macro, "currency").select(F.col("asset").alias("currency"), "macro")
    both = S.currency_composite(mapped, points).select(F.col("currency").alias("asset"), F.col("composite").alias("score"))
    one = lambda name: newest.where(F.col("series_id") == name).select("score", F.lit(True).alias("has_data"))
    gold = S.gold_composite(one("ry"), macro.where("currency = 'R0'").select("macro"), points.where("asset = 'Gold'"))
    oil = S.oil_composite(one("wti"), points.where("asset = 'Oil'"))
    for name, rows in (("Gold", gold), ("Oil", oil)):
        both = both.unionByName(rows.select(F.lit(name).alias("asset"), F.col("composite").alias("score")))
    return both.withColumn("score", F.round("score", 12))


def _drivers(spark: SparkSession, sf: str, newest: DataFrame) -> DataFrame:
    return S.driver_lookup(S.report_rows(_scores(spark, sf, newest), _assets(spark)), M.rows(spark, M.DRIVERS, "asset string, strength string, driver string"), "mixed signals")


@query(f"WITH {SCORES} SELECT asset, ord, strength, score_text, note FROM rep")
def asset_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.report_rows(_scores(spark, sf, _roles(spark, sf)[0]), _assets(spark))


@query(f"WITH {SCORES} SELECT asset, strength, driver FROM drv")
def driver_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _drivers(spark, sf, _roles(spark, sf)[0]).select("asset", "strength", "driver")


@query(f"WITH {SCORES} SELECT asset, seq, wire FROM wire")
def first_wire_per_asset(spark: SparkSession, sf: str) -> DataFrame:
    return N.first_wires(M.articles(spark, sf), _assets(spark))


@query(f"""WITH {SCORES}, newest_yield AS (SELECT arg_max(value, date) AS v FROM ry)
 SELECT string_agg(asset || ' | ' || strength || ' | ' || score_text || ' | ' || coalesce('wire: ' || wire, driver), chr(10) ORDER BY ord) || chr(10) || 'US 10Y Real Yield: ' || (SELECT coalesce(printf('%.2f%%', round(v, 2)), 'N/A') FROM newest_yield) AS report FROM drv LEFT JOIN wire USING (asset)""")
def hourly_report(spark: SparkSession, sf: str) -> DataFrame:
    newest, yields = _roles(spark, sf)
    return S.report_text(S.report(_drivers(spark, sf, newest), N.first_wires(M.articles(spark, sf), _assets(spark)), yields))
