"""Feeds and pages that were fetched: bodies to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.htmlx import by_config
from tidemark.functions.text import all_entities, closed_entities, closed_references, feed_content, feed_guid, html_to_text, page_guid, published, sanitize, strip_tracking_full
from tidemark.schema import BODY_LIMIT

RSS = (
    "channel struct<item: array<struct<guid: string, link: string, title: string, description: string, `content:encoded`: string, `dc:creator`: string, author: string, pubDate: string>>>, _corrupt string"
)
ATOM = (
    "entry array<struct<id: string, title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string, "
    "author: struct<name: string>, content: string, summary: string>>, _corrupt string"
)


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """Fetched bodies as files: ``url`` (the file's path) and ``body``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.substring("value", 1, BODY_LIMIT).alias("body"))


def rfc822(text: Column) -> Column:
    """Unix seconds of a date such as ``Mon, 01 Jan 2024 00:00:00 GMT``; null where it is none."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", "")
    forms = [F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z")]
    return F.coalesce(*forms).cast("bigint")


def iso(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("bigint")


def _is_atom() -> Column:
    return F.col("body").rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<feed[\s>]")


def entries(fetched: DataFrame) -> DataFrame:
    """Entries of feeds ``(source_id, body)``: ``source_id, place, guid, link, title, author, content, description, published_at, updated_at``; ``place`` is the entry's in its feed.

    A body that is no well-formed XML has no entries; see ``malformed``.
    """
    body = F.substring("body", 1, BODY_LIMIT)
    atom = _is_atom()
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    rss = fetched.where(~atom).select("source_id", F.posexplode(F.from_xml(body, RSS, options).getField("channel").getField("item")).alias("place", "e")).select(
        "source_id", "place", "e.guid", "e.link", "e.title", F.coalesce("e.dc:creator", "e.author", F.lit("")).alias("author"), F.col("e.content:encoded").alias("content"), "e.description",
        rfc822(F.col("e.pubDate")).alias("published_at"), F.lit(None).cast("bigint").alias("updated_at"),
    )
    links = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    feed = fetched.where(atom).select("source_id", F.posexplode(F.from_xml(body, ATOM, options).getField("entry")).alias("place", "e")).select(
        "source_id", "place", F.col("e.id").alias("guid"), F.get(links, F.lit(0)).getField("_href").alias("link"), "e.title", F.coalesce("e.author.name", F.lit("")).alias("author"),
        "e.content", F.col("e.summary").alias("description"), iso(F.col("e.published")).alias("published_at"), iso(F.col("e.updated")).alias("updated_at"),
    )
    return rss.unionByName(feed)


def malformed(fetched: DataFrame) -> DataFrame:
    """Feeds of which the body does not parse, by the schema of its kind: these polls count as failed."""
    options, body = {"columnNameOfCorruptRecord": "_corrupt"}, F.substring("body", 1, BODY_LIMIT)
    bad = F.when(_is_atom(), F.from_xml(body, ATOM, options).getField("_corrupt")).otherwise(F.from_xml(body, RSS, options).getField("_corrupt"))
    return fetched.where(bad.isNotNull() | ~F.coalesce(F.col("body").contains("<"), F.lit(False))).select("source_id")


def entry_items(found: DataFrame, poll_ts: int) -> DataFrame:
    """Entries to items; an entry with neither guid nor link is dropped. The write adds ``fetched_at`` and ``created_at``."""
    markup = sanitize(feed_content(F.col("content"), F.col("description")))
    return (
        found.withColumn("guid", feed_guid(F.col("guid"), F.col("link"))).where("guid is not null").withColumn("content_html", F.coalesce(markup, F.lit("")))
        .select(
            "source_id", "guid", strip_tracking_full(F.coalesce("link", F.lit(""))).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "author",
            published(F.col("published_at"), F.col("updated_at"), F.lit(poll_ts)).cast("bigint").alias("published_at"), "content_html", html_to_text(F.col("content_html")).alias("content_text"),
            *(["place"] if "place" in found.columns else []),
        )
    )


def page_items(pages: DataFrame, poll_ts: int, closed: bool = False) -> DataFrame:
    """Articles ``(source_id, url, html, content_selector)`` to items: by the selector where there is one (no title then), else by rule.

    With ``closed`` only references that end with a semicolon are decoded; else all that browsers decode.
    """
    decode = closed_entities if closed else all_entities
    pages = pages.withColumn("html", closed_references("html")) if closed else pages
    rows = pages.withColumn("url", strip_tracking_full("url")).withColumn("part", by_config("html", F.coalesce("content_selector", F.lit(""))))
    return rows.select("source_id", "url", "part.title", F.col("part.content").alias("raw")).select(
        "source_id", page_guid(F.col("url"), F.col("title")).alias("guid"), "url", "title", F.lit("").alias("author"), F.lit(poll_ts).cast("bigint").alias("published_at"),
        sanitize("raw").alias("content_html"), html_to_text(sanitize("raw"), decode).alias("content_text"),
    )

