"""A round of polls: the answers of sources to new items, and to what each source's state becomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.htmlx import page_links
from tidemark.functions.text import strip_tracking_full
from tidemark.operators.store import new_urls, upsert_items
from tidemark.plans.poll import outcome
from tidemark.sources.answers import body_text
from tidemark.sources.feeds import entries, entry_items, malformed, page_items
from tidemark.tables import kept


def _polls(asked: DataFrame, fresh: DataFrame, parsed, ts: int) -> DataFrame:
    """One poll for each answer of a source: ``source_id, seq, ts, outcome, etag, last_modified, new_items``."""
    counts = fresh.groupBy("source_id").agg(F.count("*").alias("new_items"))
    rows = asked.join(counts, "source_id", "left").withColumn("new_items", F.coalesce("new_items", F.lit(0)))
    return rows.select(
        "source_id", F.col("fetched_at").alias("seq"), F.lit(ts).cast("bigint").alias("ts"), outcome(F.col("type"), F.coalesce("status", F.lit(0)), F.col("new_items"), parsed).alias("outcome"),
        "etag", "last_modified", "new_items",
    )


def feed_round(sources: DataFrame, items: DataFrame, answers: DataFrame, ts: int) -> tuple[DataFrame, DataFrame]:
    """Answers of rss sources, one each, to the items that are new and the polls for ``apply_polls``.

    ``answers`` are those of ``sources.answers``, of which a round has one for a source. A body that does not parse, an error, or a status other than 200, 304, 404 and 410 is a
    failure. Of entries with one guid the first of the feed is stored.
    """
    rss = sources.where("type = 'rss' and not is_dead").select(F.col("id").alias("source_id"), "type")
    asked = answers.join(rss, "source_id")
    fetched = asked.where("status = 200").select("source_id", body_text(F.col("body")).alias("body"))
    found = entry_items(entries(fetched), ts)
    fresh = kept(upsert_items(items, found, "place").drop("place"))  # read by the caller and for the counts
    bad = malformed(fetched).select("source_id", F.lit(True).alias("bad"))
    return fresh, _polls(asked.drop("body").join(bad, "source_id", "left"), fresh, F.col("bad").isNull(), ts)


def page_round(sources: DataFrame, items: DataFrame, answers: DataFrame, ts: int, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers of html sources, index pages and articles, to the items that are new and the polls for ``apply_polls``.

    An answer for a source's own url is its index page: its links within the selector, to its own host, stripped and once each, less those stored, are the articles
    to store, from their answers of status 200; others are tried again in a later round and count for nothing. A source without a scraper config is not polled at all. ``closed`` is that of ``page_items``.
    """
    html = sources.where("type = 'html' and not is_dead and scraper_config is not null").select(F.col("id").alias("source_id"), "type", F.col("url").alias("_index"), "scraper_config")
    asked = answers.join(html, "source_id").where("url = _index")
    index = asked.where("status = 200").select("source_id", F.coalesce("final_url", "url").alias("base"), body_text(F.col("body")).alias("html"), F.coalesce("scraper_config.index_selector", F.lit("")).alias("selector"))
    links = index.select("source_id", F.explode(page_links("base", "html", F.col("selector"))).alias("link"))
    wanted = new_urls(links.select("source_id", strip_tracking_full("link").alias("url")), items)
    got = answers.where("status = 200").select("source_id", "url", body_text(F.col("body")).alias("html")).join(wanted, ["source_id", "url"])
    configs = html.select("source_id", F.col("scraper_config.content_selector").alias("content_selector"))
    made = page_items(got.join(configs, "source_id"), ts, closed).withColumn("place", F.col("url"))
    fresh = kept(upsert_items(items, made, "place").drop("place"))
    return fresh, _polls(asked.drop("body"), fresh, F.lit(True), ts)
