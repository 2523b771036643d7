"""Readers with stated schemas, and the extraction of channel pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored

REGISTRY = "client_name string, key string, telegram_id string, duration string, created_at string, expires_at string, status string, bound_mobile_id string, bound_pc_id string, bound_at string"
SESSION = "struct<key:string,dev_type:string,last_active:string,user_name:string,expiry_info:string,is_admin:boolean>"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """series_id, date, value (text) from JSON payloads {series_id, observations: [{date, value}]} (A1)."""
    raw = spark.read.schema("series_id string, observations array<struct<date:string,value:string>>").json(path)
    return raw.select("series_id", F.explode("observations").alias("o")).select("series_id", "o.date", "o.value")


def read_rss_items(spark: SparkSession, path: str, per_feed: int = 4, feed: str | None = None, order: str | None = None, extra: str = "") -> DataFrame:
    """feed, item_rank, title, description, published_at of the first items of each feed (A3).

    A feed is a file in its own order unless columns of the items (in `extra`) say otherwise.
    """
    from ..operators.news import strip_tags, top_per_key

    schema = "title string, description string, summary string, pubDate string" + (f", {extra}" if extra else "")
    raw = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    raw = raw.select((F.col(feed) if feed else F.input_file_name()).alias("feed"), (F.col(order) if order else F.monotonically_increasing_id()).alias("at"), "title", F.coalesce("summary", "description", F.lit("")).alias("body"), "pubDate")
    rows = top_per_key(raw, "feed", "at", per_feed)
    return rows.select("feed", F.col("rank").alias("item_rank"), "title", strip_tags(F.col("body")).alias("description"), F.substring("pubDate", 1, 16).alias("published_at"))


def read_registry(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON array, or with multi_line=False one row a line."""
    return spark.read.schema(REGISTRY).option("multiLine", multi_line).json(path)


def read_sessions(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """device_id and the session's fields from JSON objects keyed by device: one in each file or, with whole=False, in each line (A5)."""
    text = spark.read.option("wholetext", whole).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{SESSION}>")).alias("device_id", "s")).select("device_id", "s.*")


def union_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """The first `keep` items (feed, seq, title, description, published_at) of each feed as one table with the order key (feed_rank, item_rank) (A4).

    feeds (feed, feed_rank, keep) lists channels, then RSS feeds. feed_order() numbers all of them.
    """
    from ..operators.news import top_per_key

    most = feeds.agg(F.max("keep")).first()[0] or 0
    rows = top_per_key(items, "feed", "seq", most).withColumnRenamed("rank", "item_rank").join(feeds, "feed")
    return rows.where("item_rank <= keep").select("feed_rank", "item_rank", "title", "description", "published_at")


def feed_order(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """items (feed, seq, any other columns) with feed_rank and `at`, their places from 0 in one list by feed and, within it, seq (A4): no gaps, and no task with all rows of the list or of a feed."""
    from ..operators.ordering import numbered

    rows = items.join(feeds.select("feed", "feed_rank"), "feed")
    return numbered(stored(rows, "feed-items"), "feed_rank", "seq")


class _Texts(HTMLParser):
    """Texts of elements of one tag and class, and one attribute of elements of another."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, tag: str, cls: str | None, time_tag: str, time_cls: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.cls, self.time_tag, self.time_cls = tag, cls, time_tag, time_cls
        self.texts: list[list[str]] = []
        self.times: list[str] = []
        self.open: list[tuple[int, int]] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = dict(attrs)
        classes = (has.get("class") or "").split()
        if tag == self.time_tag and (self.time_cls is None or self.time_cls in classes):
            self.times.append(has.get("datetime") or "")
        if tag in self.VOID:
            return
        if tag == self.tag:
            self.depth += 1
            if self.cls is None or self.cls in classes:
                self.open.append((self.depth, len(self.texts)))
                self.texts.append([])

    def handle_endtag(self, tag: str) -> None:
        if tag == self.tag and self.depth:
            while self.open and self.open[-1][0] >= self.depth:
                self.open.pop()
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        for _, at in self.open:
            self.texts[at].append(data)


def extract_messages(pages: DataFrame, tag: str = "div", cls: str | None = "message_text", time_tag: str = "time", time_cls: str | None = "time", keep: int = 10, longer_than: int = 15, need_time: bool = True) -> DataFrame:
    """page_id, item_rank (newest first), text, time: the last messages of a page by position with its last times (A2).

    Both lists are cut separately and joined by position, up to the shorter
    one. need_time=False takes messages alone. Parsing is Python in Arrow batches.
    """
    schema = T.StructType([pages.schema["page_id"], T.StructField("item_rank", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("time", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                p = _Texts(tag, cls, time_tag, time_cls)
                p.feed(html or "")
                p.close()
                texts = [" ".join(x).strip() for x in p.texts[-keep:]]
                pairs = list(zip(texts, p.times[-keep:], strict=False)) if need_time else [(t, None) for t in texts]
                found = [(t, w) for t, w in pairs if len(t) > longer_than]
                out += [(page, k, t, w and w[:16].replace("T", " ")) for k, (t, w) in enumerate(reversed(found), 1)]
            yield pd.DataFrame(out, columns=schema.names)

    return pages.select("page_id", "html").mapInPandas(run, schema)
