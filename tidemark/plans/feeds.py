"""Queries on articles, pages, calendars, the registry and sessions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import indicators as I
from ..operators import news as N
from ..operators import registry as R
from ..operators import scores as S
from ..operators.ordering import numbered
from ..sources import readers, store
from ..shared import stored
from . import model as M
from . import series
from .model import ARTICLES, LOGINS, REGISTRY, SETS, bias, hit, literal, r6, values

QUERIES: dict = {}
SQL: dict[str, str] = {}
TRIM = "regexp_replace(title, '^\\s+|\\s+$', '', 'g')"
NOW = datetime.datetime(1998, 6, 19, 12)


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents of a channel page of the query.
PER_PAGE = 25


@query(f"""WITH m AS (SELECT doc_id // {PER_PAGE} AS page_id, doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') || ' 07:08' AS time, row_number() OVER (PARTITION BY doc_id // {PER_PAGE} ORDER BY doc_id DESC) AS back FROM documents)
 SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY back) AS INTEGER) AS item_rank, text, time FROM m WHERE back <= 10 AND length(text) > 15""")
def extract_channel_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A2: documents as messages of channel pages, written as such and taken out of the markup again."""
    docs = M.table(spark, sf, "documents")
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    when = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    message = F.concat(F.lit('<div class="meta"><time class="time" datetime="'), when, F.lit('T07:08:09+00:00">07:08</time></div><div class="message_text js">'), text, F.lit("</div>"))
    rows = docs.groupBy(F.expr(f"doc_id div {PER_PAGE}").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", message.alias("html")))).alias("m"))
    path = M.scratch(spark, "channel-pages")
    rows.select("page_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("m", lambda x: x["html"]), ""), F.lit("</body></html>")).alias("html")).write.parquet(path)
    return readers.extract_messages(spark.read.parquet(path))


ITEM = "trim(regexp_replace(substr(text, 1, 60), '[^A-Za-z]+', ' ', 'g'))"


@query(f"""WITH i AS (SELECT doc_id, source AS feed, {ITEM} AS title, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS body FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 4)
 SELECT feed, title, substr(body || ' more', 1, 140) AS description, 'Mon, 24 Aug 2026' AS published_at FROM i""")
def read_rss_items(spark: SparkSession, sf: str) -> DataFrame:
    """A3: whole documents written as XML items (built-in format), read back, the first four of each feed."""
    path = M.scratch(spark, "rss")
    letters = lambda text: F.trim(F.regexp_replace(text, "[^A-Za-z]+", " "))
    items = M.table(spark, sf, "documents").select(F.col("doc_id").alias("guid"), F.col("source").alias("feed"), letters(F.substring("text", 1, 60)).alias("title"), F.concat(F.lit("<p>"), letters(F.col("text")), F.lit("</p> more")).alias("summary"))
    items.withColumn("pubDate", F.lit("Mon, 24 Aug 2026 10:00:00 GMT")).write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    rows = readers.read_rss_items(spark, path, feed="feed", order="guid", extra="guid long, feed string")
    return rows.select("feed", "title", "description", "published_at")


#: Feeds, in the order of their names, that are channels; the others are RSS feeds.
CHANNELS = 4


@query(f"""WITH {ARTICLES}, f AS (SELECT feed, row_number() OVER (ORDER BY feed) - 1 AS feed_rank FROM (SELECT DISTINCT feed FROM articles)), r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY seq) AS item_rank FROM articles)
 SELECT CAST(feed_rank AS INTEGER) AS feed_rank, item_rank, title, description, feed AS published_at FROM r JOIN f USING (feed) WHERE item_rank <= CASE WHEN feed_rank < {CHANNELS} THEN 10 ELSE 4 END""")
def union_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """A4: the first items of every source."""
    rows = M.articles(spark, sf).withColumn("published_at", F.col("feed"))
    feeds = _feeds(rows).withColumn("keep", F.when(F.col("feed_rank") < CHANNELS, 10).otherwise(4))
    return readers.union_feeds(rows, feeds)


def _feeds(rows: DataFrame) -> DataFrame:
    """feed, feed_rank by name."""
    feeds = numbered(stored(rows.select("feed").distinct(), "feeds"), "feed", name="feed_rank")
    return feeds.withColumn("feed_rank", F.col("feed_rank").cast("int"))


@query(f"""WITH {ARTICLES}, f AS (SELECT feed, row_number() OVER (ORDER BY feed) - 1 AS feed_rank FROM (SELECT DISTINCT feed FROM articles))
 SELECT seq, feed, CAST(feed_rank AS INTEGER) AS feed_rank, row_number() OVER (ORDER BY feed_rank, seq) - 1 AS at FROM articles JOIN f USING (feed)""")
def feed_order(spark: SparkSession, sf: str) -> DataFrame:
    """A4: all articles as one list with their places in it."""
    rows = M.articles(spark, sf).select("seq", "feed")
    return readers.feed_order(rows, _feeds(rows)).select("seq", "feed", "feed_rank", "at")


@query(f"WITH {REGISTRY} SELECT * FROM registry")
def read_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the registry written as JSON rows and read with its stated schema."""
    path = M.scratch(spark, "registry")
    M.registry(spark, sf).write.json(path)
    return readers.read_registry(spark, path, multi_line=False)


SESSION_TIME = "%Y-%m-%d %H:%M:%S"


@query(f"""WITH s AS (SELECT user_id, min(event_id) AS first, max(ts) AS last FROM events GROUP BY user_id)
 SELECT 'dev' || user_id AS device_id, 'K' || (first % 97) AS key, CASE WHEN user_id % 2 = 0 THEN 'PC' ELSE 'Mobile' END AS dev_type, strftime(last, '{SESSION_TIME}') AS last_active, 'user "' || user_id || '"' AS user_name, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'Lifetime' END AS expiry_info, user_id % 5 = 0 AS is_admin FROM s""")
def read_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A5: session maps, an object of a hundred devices a line, written as JSON and read again."""
    u = F.col("user_id")
    rows = M.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("ts").alias("last"))
    session = F.struct(F.concat(F.lit("K"), (F.col("first") % 97).cast("string")).alias("key"), F.when(u % 2 == 0, "PC").otherwise("Mobile").alias("dev_type"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_active"), F.concat(F.lit('user "'), u.cast("string"), F.lit('"')).alias("user_name"), F.when(u % 3 != 0, "Lifetime").alias("expiry_info"), (u % 5 == 0).alias("is_admin"))
    entries = rows.select(F.expr("user_id div 100").alias("block"), F.struct(F.concat(F.lit("dev"), u.cast("string")), session).alias("e"))
    path = M.scratch(spark, "sessions")
    entries.groupBy("block").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).select("value").write.text(path)
    return readers.read_sessions(spark, path, whole=False)


@query(f"WITH {REGISTRY}, a AS (SELECT DISTINCT trim(telegram_id) AS chat_id FROM registry WHERE status = 'Active' AND trim(telegram_id) <> '') SELECT chat_id, kind, message FROM a CROSS JOIN (VALUES ('report', 'hourly'), ('alert', 'weekend')) m(kind, message)")
def write_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each recipient and message, written by kind and read again."""
    path = M.scratch(spark, "outbox")
    messages = M.rows(spark, [("report", "hourly"), ("alert", "weekend")], "kind string, message string")
    R.outbox(R.recipients(M.registry(spark, sf)), messages).write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).select("chat_id", F.col("kind").cast("string").alias("kind"), "message")


@query(f"""WITH {REGISTRY}, u AS (SELECT DISTINCT 'K' || o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT'), v AS (SELECT r.key, status, telegram_id, u.key IS NOT NULL AS hit FROM registry r LEFT JOIN u ON u.key = r.key)
 SELECT key, CASE WHEN hit THEN 'Revoked' ELSE status END AS status, CASE WHEN key LIKE '%7' THEN '' ELSE telegram_id END AS telegram_id FROM v""")
def stored_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the registry saved, changed twice in the store, and loaded."""
    folder = M.scratch(spark, "registry-store")
    keys = M.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("key"))
    edits = keys.distinct().select(F.lit(1).alias("seq"), "key", F.lit("revoke").alias("op"), F.lit("").alias("arg"))
    store.save_registry(M.registry(spark, sf), folder)
    store.change_registry(spark, folder, lambda rows: R.apply_edits(rows, edits))
    store.change_registry(spark, folder, lambda rows: rows.withColumn("telegram_id", F.when(F.col("key").endswith("7"), "").otherwise(F.col("telegram_id"))))
    return store.load_registry(spark, folder).select("key", "status", "telegram_id")


@query(f"WITH {ARTICLES} SELECT seq FROM articles WHERE length({TRIM}) >= 14")
def title_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return M.articles(spark, sf).where(N.long_enough(F.col("title"))).select("seq")


@query("SELECT doc_id AS seq, CASE WHEN length(text) > 110 THEN substr(text, 1, 110) || '...' ELSE text END AS title, text AS description, replace(substr('2024-05-06T07:08:09', 1, 16), 'T', ' ') AS published_at FROM documents WHERE length(text) > 15")
def normalize_article(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.table(spark, sf, "documents").where(F.length("text") > 15)
    return rows.select(F.col("doc_id").alias("seq"), *N.normalize(F.col("text"), F.lit("2024-05-06T07:08:09")))


@query("SELECT page_id, substr(regexp_replace(html, '<[^>]+>', '', 'g'), 1, 140) AS description FROM pages")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return M.table(spark, sf, "pages").select("page_id", N.strip_tags(F.col("html")).alias("description"))


@query("SELECT event_id, epoch_us(CASE WHEN event_id % 3 = 0 THEN date_trunc('minute', ts) WHEN event_id % 3 = 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END) AS micros FROM events")
def parse_published_at(spark: SparkSession, sf: str) -> DataFrame:
    """Both text forms of an event's time, and one that is neither, parsed by one expression."""
    form = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy"))).otherwise("soon")
    return M.table(spark, sf, "events").select("event_id", F.unix_micros(N.published_ts(form)).alias("micros"))


LOCAL = "(ts + INTERVAL 3 HOURS)"


@query(f"SELECT event_id FROM events WHERE isodow({LOCAL}) >= 6")
def weekend_filter(spark: SparkSession, sf: str) -> DataFrame:
    return M.table(spark, sf, "events").where(F.weekday(F.expr("ts + INTERVAL 3 HOURS")).isin(5, 6)).select("event_id")


@query(f"WITH {REGISTRY} SELECT key, trim(telegram_id) AS chat_id FROM registry WHERE status = 'Active' AND trim(telegram_id) <> ''")
def recipient_filter(spark: SparkSession, sf: str) -> DataFrame:
    return M.registry(spark, sf).where((F.col("status") == "Active") & (F.trim("telegram_id") != "")).select("key", F.trim("telegram_id").alias("chat_id"))


@query(f"WITH {REGISTRY} SELECT DISTINCT trim(telegram_id) AS chat_id FROM registry WHERE status = 'Active' AND trim(telegram_id) <> ''")
def distinct_recipients(spark: SparkSession, sf: str) -> DataFrame:
    return R.recipients(M.registry(spark, sf))


@query(f"WITH {ARTICLES} SELECT string_agg('- ' || title || ': ' || description, chr(10) ORDER BY seq) AS digest FROM (SELECT * FROM articles ORDER BY seq LIMIT 6)")
def news_digest_text(spark: SparkSession, sf: str) -> DataFrame:
    return N.digest_text(M.articles(spark, sf))


@query(f"WITH {ARTICLES} SELECT feed, seq, row_number() OVER (PARTITION BY feed ORDER BY seq) AS rank FROM articles QUALIFY rank <= 10")
def per_feed_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return N.top_per_key(M.articles(spark, sf).select("feed", "seq"), "feed", "seq", 10).select("feed", "seq", "rank")


@query(f"WITH {ARTICLES}, {SETS} SELECT seq, words FROM kw")
def title_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return M.articles(spark, sf).where(N.long_enough(F.col("title"))).select("seq", F.array_sort(N.title_keywords(F.col("title"))).alias("words"))


@query(f"""WITH {ARTICLES}, kw AS MATERIALIZED (SELECT seq, {M.WORDS} AS words FROM articles),
 pairs AS (SELECT a.seq AS a, b.seq AS b, len(list_intersect(a.words, b.words)) AS s, len(a.words) + len(b.words) AS t FROM kw a JOIN kw b ON a.seq < b.seq AND 20 * least(len(a.words), len(b.words)) >= 11 * greatest(len(a.words), len(b.words)))
 SELECT a, b, {r6("s / (t - s)")} AS jaccard FROM pairs WHERE s > 0 AND 20 * s >= 11 * (t - s)""")
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """H2: every pair of articles, also of copies and of titles of any length."""
    return N.all_near_duplicate_pairs(M.articles(spark, sf)).select("a", "b", (F.round("jaccard", 6) + 0.0).alias("jaccard"))


DEDUP = f"""{ARTICLES}, {SETS}, nb AS MATERIALIZED (SELECT b AS seq, list(a) AS nbrs FROM near GROUP BY b), nodes AS MATERIALIZED (SELECT seq, coalesce(nbrs, []) AS nbrs, row_number() OVER (ORDER BY seq) AS i FROM sets LEFT JOIN nb USING (seq)),
 fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(f.kept, n.nbrs) THEN f.kept ELSE list_append(f.kept, n.seq) END FROM fold f JOIN nodes n ON n.i = f.i + 1),
 kept AS (SELECT unnest(kept) AS seq FROM fold WHERE i = (SELECT max(i) FROM fold) UNION ALL SELECT seq FROM kw WHERE len(words) = 0)"""


@query(f"WITH RECURSIVE {DEDUP} SELECT seq FROM kept")
def dedup_articles(spark: SparkSession, sf: str) -> DataFrame:
    return N.dedup_articles(M.articles(spark, sf))


@query(f"WITH RECURSIVE {DEDUP} SELECT seq, title FROM kept JOIN articles USING (seq) ORDER BY seq LIMIT 6")
def top_wires(spark: SparkSession, sf: str) -> DataFrame:
    articles = M.articles(spark, sf)
    return articles.join(N.dedup_articles(articles), "seq").orderBy("seq").limit(6).select("seq", "title")


@query(f"""WITH e AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT *, CAST(d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS day FROM e)
 SELECT 'O' || o_orderkey AS code, o_orderkey AS template_ord, day AS event_date, CAST(day - DATE '{NOW:%Y-%m-%d}' AS INTEGER) AS days_away, CASE WHEN day = DATE '{NOW:%Y-%m-%d}' THEN 'TODAY' WHEN day > DATE '{NOW:%Y-%m-%d}' THEN 'In ' || CAST(day - DATE '{NOW:%Y-%m-%d}' AS INTEGER) || ' Days' ELSE 'Released' END AS countdown, strftime(day, '%A, %b %d') AS shown,
 lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' AS time_str, (o_custkey % 50) || '%' AS forecast_str, CASE o_orderstatus WHEN 'P' THEN '—' ELSE o_orderstatus END AS prev_str, o_orderpriority AS consensus_bias FROM m""")
def upcoming_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a calendar, some of it past, with the columns that its template carries."""
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    rows = M.table(spark, sf, "orders").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("code"),
        F.col("o_orderkey").alias("template_ord"),
        F.datediff(F.to_date("o_orderdate"), F.lit(NOW.date())).alias("day_offset"),
        F.concat(hour, F.lit(":30")).alias("time_str"),
        F.concat((F.col("o_custkey") % 50).cast("string"), F.lit("%")).alias("forecast_str"),
        F.when(F.col("o_orderstatus") == "P", "—").otherwise(F.col("o_orderstatus")).alias("prev_str"),
        F.col("o_orderpriority").alias("consensus_bias"),
    )
    return S.upcoming(rows, NOW)


# Registry.
@query(f"WITH {REGISTRY} SELECT key, CASE WHEN status = 'Revoked' THEN 'Revoked' WHEN expires_at = 'Lifetime' OR expires_at >= '{M.TODAY}' THEN 'Active' ELSE 'Expired' END AS state FROM registry")
def license_status(spark: SparkSession, sf: str) -> DataFrame:
    return M.registry(spark, sf).select("key", R.license_status(F.col("status"), F.col("expires_at"), M.TODAY).alias("state"))


@query(f"WITH {REGISTRY}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'Revoked' AND (expires_at = 'Lifetime' OR expires_at >= '{M.TODAY}')) AS active FROM registry) SELECT total, active, total - active AS expired_or_revoked FROM s")
def registry_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return R.kpis(M.registry(spark, sf), M.TODAY)


@query(f"WITH {REGISTRY} SELECT key, CASE WHEN bound_mobile_id <> '' AND bound_pc_id <> '' THEN 'both' WHEN bound_mobile_id <> '' THEN 'mobile' WHEN bound_pc_id <> '' THEN 'pc' ELSE 'none' END AS slots FROM registry")
def device_slots(spark: SparkSession, sf: str) -> DataFrame:
    return M.registry(spark, sf).select("key", R.device_slots(F.col("bound_mobile_id"), F.col("bound_pc_id")).alias("slots"))


@query(f"WITH {REGISTRY} SELECT key FROM registry WHERE NOT EXISTS (SELECT 1 FROM orders WHERE 'K' || o_custkey = key AND o_orderpriority = '1-URGENT')")
def registry_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    keys = M.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("key"))
    return R.without_keys(M.registry(spark, sf), keys).select("key")


@query(f"""WITH {REGISTRY}, ch AS (SELECT 'K' || o_custkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_orderkey AS ingest FROM orders WHERE o_orderpriority = '1-URGENT'),
 l AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, ingest DESC) = 1)
 SELECT key, created_at, 'order ' || ingest AS client_name FROM l UNION ALL SELECT key, created_at, client_name FROM registry WHERE key NOT IN (SELECT key FROM l)""")
def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """H5: urgent orders as new client rows."""
    orders = M.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    changes = orders.select(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderkey").alias("ingest"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("client_name"))
    return R.upsert(M.registry(spark, sf).select("key", "created_at", "client_name"), changes)


@query(f"""WITH {REGISTRY}, e AS (SELECT 'K' || user_id AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'revoke' WHEN 'click' THEN 'chat' ELSE CASE WHEN event_id % 7 = 0 THEN 'reset' WHEN event_id % 97 = 0 THEN 'delete' ELSE 'none' END END AS op, 'c' || event_id AS arg FROM events),
 b AS (SELECT key, arg_max(arg, seq) FILTER (WHERE op = 'chat') AS chat, bool_or(op = 'reset') AS rs, bool_or(op = 'revoke') AS rv, bool_or(op = 'delete') AS del FROM e GROUP BY key)
 SELECT r.key, coalesce(chat, telegram_id) AS telegram_id, CASE WHEN rv THEN 'Revoked' ELSE status END AS status, CASE WHEN rs THEN '' ELSE bound_mobile_id END AS bound_mobile_id, CASE WHEN rs THEN '' ELSE bound_pc_id END AS bound_pc_id FROM registry r LEFT JOIN b USING (key) WHERE NOT coalesce(del, FALSE)""")
def registry_edits(spark: SparkSession, sf: str) -> DataFrame:
    e = M.table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "revoke").when(F.col("event_type") == "click", "chat").when(F.col("event_id") % 7 == 0, "reset").when(F.col("event_id") % 97 == 0, "delete").otherwise("none")
    edits = e.select(F.concat(F.lit("K"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("arg"))
    return R.apply_edits(M.registry(spark, sf), edits).select("key", "telegram_id", "status", "bound_mobile_id", "bound_pc_id")


NAME, UNTIL = "'C' || c_custkey", "CASE c_custkey % 5 WHEN 0 THEN 'LIFETIME' WHEN 1 THEN '20240701' WHEN 2 THEN '20250101' WHEN 3 THEN '20231231' ELSE '20241399' END"


@query(f"""WITH p AS (SELECT c_custkey, {NAME} AS name, {UNTIL} AS until FROM customer), k AS (SELECT c_custkey, name, until, upper(substr(sha256(name || ':' || until || ':{M.SALT}'), 1, 4)) AS good FROM p),
 q AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'XXXX' ELSE good END AS sig, c_custkey % 11 = 0 AS bad, c_custkey % 13 = 0 AS gone FROM k),
 v AS (SELECT *, sig = good AND NOT bad AS ours, try_strptime(until, '%Y%m%d') AS d FROM q)
 SELECT ' ' || CASE WHEN bad THEN 'other-' ELSE '{M.PREFIX.lower()}-' END || lower(name || '-' || until || '-' || sig) AS presented, CASE WHEN gone THEN 'revoked' WHEN ours AND until = 'LIFETIME' THEN 'lifetime' WHEN ours AND d >= DATE '{M.TODAY}' THEN 'valid' WHEN ours AND d < DATE '{M.TODAY}' THEN 'expired' ELSE 'unrecognized' END AS verdict,
 CASE WHEN NOT gone AND ours AND until <> 'LIFETIME' AND d >= DATE '{M.TODAY}' THEN CAST(CAST(d AS DATE) - DATE '{M.TODAY}' AS INTEGER) END AS days_left FROM v""")
def license_audit(spark: SparkSession, sf: str) -> DataFrame:
    """L3: keys derived from customers, some with a wrong signature, prefix or date, some revoked."""
    k = F.col("c_custkey")
    name, until = F.expr("concat('C', c_custkey)"), F.expr("CASE c_custkey % 5 WHEN 0 THEN 'LIFETIME' WHEN 1 THEN '20240701' WHEN 2 THEN '20250101' WHEN 3 THEN '20231231' ELSE '20241399' END")
    good = F.upper(F.substring(F.sha2(F.concat_ws(":", name, until, F.lit(M.SALT)).cast("binary"), 256), 1, 4))
    sig = F.when(k % 7 == 0, "XXXX").otherwise(good)
    shown = F.concat(F.lit(" "), F.when(k % 11 == 0, "other-").otherwise(f"{M.PREFIX.lower()}-"), F.lower(F.concat_ws("-", name, until, sig)))
    rows = M.table(spark, sf, "customer").select("c_custkey", shown.alias("presented"))
    revoked = rows.where(k % 13 == 0).select(F.upper(F.trim("presented")).alias("key"), F.lit("Revoked").alias("status"))
    return R.audit(rows.select("presented"), revoked, M.TODAY, M.SALT, M.PREFIX)


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE '10.0.0.' || (user_id % 250) || ', 1.2.3.4' END AS ip, CASE event_type WHEN 'click' THEN 'Mozilla iPhone OS' WHEN 'error' THEN '' ELSE 'Mozilla X11 ' || repeat('x', 90) END AS ua FROM events),
 b AS (SELECT *, trim(split_part(ip, ',', 1)) AS first, lower(ua) AS low FROM a)
 SELECT event_id, CASE WHEN first <> '' AND ua <> '' THEN CASE WHEN contains(low, 'iphone') OR contains(low, 'android') OR contains(low, 'ipad') OR contains(low, 'mobile') OR contains(low, 'ipod') OR contains(low, 'touch') THEN 'Mobile' ELSE 'PC' END END AS dev_type,
 CASE WHEN first <> '' AND ua <> '' THEN substr(sha256(first || ':' || substr(low, 1, 80)), 1, 16) END AS device_id FROM b""")
def device_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    ip = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(", 1.2.3.4")))
    agent = F.when(F.col("event_type") == "click", "Mozilla iPhone OS").when(F.col("event_type") == "error", "").otherwise("Mozilla X11 " + "x" * 90)
    kind, device = R.fingerprint(ip, agent)
    return M.table(spark, sf, "events").select("event_id", kind.alias("dev_type"), device.alias("device_id"))


BOUND = f"{LOGINS}, b AS (SELECT *, first_value(CASE WHEN coalesce(device_id, '') <> '' THEN device_id END IGNORE NULLS) OVER (PARTITION BY key, dev_type ORDER BY login_ts, login_id ROWS UNBOUNDED PRECEDING) AS bound FROM logins)"


@query(f"WITH {BOUND} SELECT login_id, bound, coalesce(bound <> coalesce(device_id, ''), FALSE) AS violation FROM b")
def first_device_binding(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_binding(M.logins(spark, sf)).select("login_id", "bound", "violation")


@query(f"WITH {BOUND} SELECT key, dev_type, count(*) AS violations FROM b WHERE coalesce(bound <> coalesce(device_id, ''), FALSE) GROUP BY key, dev_type")
def stream_device_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Batch twin of J4."""
    return R.first_binding(M.logins(spark, sf)).where("violation").groupBy("key", "dev_type").agg(F.count("*").alias("violations"))


@query("""WITH g AS (SELECT user_id AS device_id, ts, CASE WHEN coalesce(ts > lag(ts) OVER w + INTERVAL 12 HOURS, TRUE) THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(nw) OVER (PARTITION BY device_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT device_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY device_id, session""")
def rolling_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """J5 in batch; half a day where the reference has five, which would join all of the tables' events."""
    rows = R.sessions(M.table(spark, sf, "events").select(F.col("user_id").alias("device_id"), "ts"), hours=12)
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})").alias(c)
    return rows.select("device_id", "session", micros("start"), micros("last"), "n")


# Batch twins of the article streams: events take the place of articles, their type and properties that of the text.
EVENT_TEXT = "event_type || ' ' || props"
UP, DOWN, URGENT = ["click", "purchase"], ["error"], ["error", '"k": 7']


MACRO = f"{series.TABLE}, {values('map', 'asset, currency', series.MAP)}, am AS (SELECT asset, macro FROM map JOIN macro USING (currency))"
STREAM_DELTA = "0.04 * (sum(CAST({up} AS INTEGER)) - sum(CAST({down} AS INTEGER)))"


def _delta(text: str) -> str:
    return STREAM_DELTA.format(up=hit(text, UP), down=hit(text, DOWN))


@query(f"""WITH {MACRO}, h AS (SELECT date_trunc('hour', {LOCAL}) AS hour, count(*) AS n, {_delta(EVENT_TEXT)} AS delta FROM events WHERE isodow({LOCAL}) <= 5 GROUP BY 1),
 p AS (SELECT hour, asset, macro, {series.POINT} AS points FROM h CROSS JOIN am), s AS (SELECT hour, asset, round(0.5 * macro + 0.5 * (points / 0.5), 12) AS score FROM p)
 SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, asset, {r6('score')} AS score, {bias('score')} AS strength FROM s""")
def stream_hourly_report(spark: SparkSession, sf: str) -> DataFrame:
    """Batch twin of J1: the report of each clock hour of a weekday, a row for each asset."""
    from ..streaming import streams as X

    windows = X.hourly(X.as_articles(M.table(spark, sf, "events")), UP, DOWN)
    macro = M.rows(spark, series.MAP, "asset string, currency string").join(I.macro_score(series._table(spark, sf)), "currency").select("asset", "macro")
    rows = X.hourly_report(windows, stored(macro, "hourly-macro"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "asset", (F.round("score", 6) + 0.0).alias("score"), "strength")


@query(f"""WITH RECURSIVE e AS (SELECT event_id, {EVENT_TEXT} AS title, {LOCAL} AS l FROM events WHERE isodow({LOCAL}) >= 6),
 r AS (SELECT *, CAST(CAST(date_trunc('day', l) AS DATE) - CAST(isodow(l) - 6 AS INTEGER) AS DATE) AS weekend, date_trunc('hour', l) AS tick FROM e QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', l) ORDER BY event_id) <= 4),
 t AS MATERIALIZED (SELECT weekend, tick, list({{'title': title, 'event_id': event_id}} ORDER BY event_id) AS c, row_number() OVER (PARTITION BY weekend ORDER BY tick) AS i FROM r WHERE {hit('title', URGENT)} GROUP BY weekend, tick),
 f AS (SELECT DISTINCT weekend, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS STRUCT(title VARCHAR, event_id BIGINT)) AS pick FROM t
 UNION ALL SELECT t.weekend, t.i, CASE WHEN len(list_filter(t.c, lambda x: NOT list_contains(f.seen, x.title))) > 0 THEN list_append(f.seen, list_filter(t.c, lambda x: NOT list_contains(f.seen, x.title))[1].title) ELSE f.seen END, list_filter(t.c, lambda x: NOT list_contains(f.seen, x.title))[1] FROM f JOIN t ON t.weekend = f.weekend AND t.i = f.i + 1)
 SELECT weekend, pick.event_id AS event_id, pick.title AS title FROM f WHERE pick IS NOT NULL""")
def stream_weekend_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Batch twin of J2: an hour is a tick; of its first four articles at most one is alerted, each title once a weekend."""
    from ..streaming import streams as X

    rows = X.as_articles(M.table(spark, sf, "events")).where(F.weekday("ts") >= 5)
    rows = rows.select(F.date_sub(F.to_date("ts"), F.weekday("ts") - 5).alias("weekend"), F.date_trunc("hour", "ts").alias("tick"), F.col("event_id").alias("seq"), "title", N.any_word(F.lower("title"), URGENT).alias("urgent"))
    return X.first_of_ticks(rows).withColumnRenamed("seq", "event_id")


@query(f"""WITH {values('assets', 'asset', series.ASSET_ROWS)}, e AS (SELECT {LOCAL} AS l, {EVENT_TEXT} AS t FROM events), w AS (SELECT time_bucket(INTERVAL 5 MINUTES, l) - to_minutes(5 * k) AS s, l, t FROM e, range(12) r(k)),
 d AS (SELECT epoch_us(s) AS start, count(*) AS n, {_delta("t")} AS delta FROM w GROUP BY 1)
 SELECT start, asset, {r6(series.POINT)} AS points FROM d CROSS JOIN assets""")
def stream_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Batch twin of J3: points of each asset in sliding windows of an hour every five minutes."""
    from ..streaming import streams as X

    windows = X.sliding(X.as_articles(M.table(spark, sf, "events")), UP, DOWN).select(F.unix_micros("window.start").alias("start"), "n", "delta")
    return S.asset_points(windows, M.rows(spark, series.ASSET_ROWS, "asset string")).select("start", "asset", (F.round("points", 6) + 0.0).alias("points"))


# Streams over the events, run to their end; a row after all others moves the watermark past them.
def _stream(spark: SparkSession, rows: DataFrame, time: str, name: str) -> DataFrame:
    last = rows.agg(F.max(time).alias(time)).select((F.col(time) + F.expr("INTERVAL 100 DAYS")).alias(time), *(F.lit("0").cast(kind).alias(c) for c, kind in rows.dtypes if c != time))
    path = M.scratch(spark, name)
    rows.unionByName(last).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(f"WITH {BOUND} SELECT key, dev_type, login_id, coalesce(device_id, '') AS device_id FROM b WHERE coalesce(bound <> coalesce(device_id, ''), FALSE)")
def live_device_violations(spark: SparkSession, sf: str) -> DataFrame:
    """J4 as a stream: each violation, of logins in the order of their times."""
    from ..streaming import streams as X

    logins = M.logins(spark, sf).withColumn("login_ts", F.col("login_ts").cast("timestamp"))
    return X.drained(X.device_violations(_stream(spark, logins, "login_ts", "logins")), M.scratch(spark, "violations"))


@query(SQL["stream_weekend_alerts"])
def live_weekend_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """J2 as a stream: the alerts of each tick as the watermark closes it."""
    from ..streaming import streams as X

    articles = X.as_articles(M.table(spark, sf, "events")).select("ts", F.col("event_id").alias("seq"), "title")
    return X.drained(X.tick_alerts(_stream(spark, articles, "ts", "articles"), words=URGENT), M.scratch(spark, "alerts")).withColumnRenamed("seq", "event_id")


@query(f"""WITH {REGISTRY}, a AS (SELECT DISTINCT trim(telegram_id) AS chat_id FROM registry WHERE status = 'Active' AND trim(telegram_id) <> ''), l AS (SELECT {LOCAL} AS l, {EVENT_TEXT} AS title FROM events),
 u AS (SELECT DISTINCT 'alert ' || CAST(CAST(l AS DATE) - CAST(isodow(l) - 6 AS INTEGER) AS DATE) AS kind, title AS message FROM l WHERE isodow(l) >= 6 AND {hit("lower(title)", URGENT)})
 SELECT chat_id, kind, message FROM a CROSS JOIN u""")
def live_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """A6 as a stream: each weekend's urgent titles, once for every recipient, from the batches written whole."""
    from ..streaming import streams as X

    articles = X.as_articles(M.table(spark, sf, "events")).select("ts", F.col("event_id").alias("seq"), "title")
    alerts = X.weekend_alerts(_stream(spark, articles, "ts", "articles"), URGENT)
    messages = alerts.select(F.concat(F.lit("alert "), F.col("weekend").cast("string")).alias("kind"), F.col("title").alias("message"))
    folder = M.scratch(spark, "outbox-stream")
    X.run_to_end(messages, X.outbox_writer(stored(R.recipients(M.registry(spark, sf)), "recipients"), folder), M.scratch(spark, "outbox-checkpoint"))
    return X.read_outbox(spark, folder).select("chat_id", "kind", "message")
