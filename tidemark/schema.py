"""The feed store's tables as Spark types. Instants are unix seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDERS = "id bigint, name string, parent_id bigint, created_at bigint, updated_at bigint"
SCRAPER_CONFIG = "struct<index_selector: string, date_selector: string, content_selector: string>"
SOURCES = (
    f"id bigint, type string, url string, title string, folder_id bigint, scraper_config {SCRAPER_CONFIG}, next_poll_at bigint, "
    "last_poll_at bigint, etag string, last_modified string, consec_fails int, is_dead boolean, poll_interval bigint, created_at bigint, updated_at bigint"
)
ITEMS = (
    "id bigint, source_id bigint, guid string, url string, title string, author string, published_at bigint, fetched_at bigint, "
    "content_html string, content_text string, created_at bigint"
)
STATES = "item_id bigint, is_read boolean, is_starred boolean, read_at bigint, starred_at bigint, updated_at bigint"
TOMBSTONES = "id bigint, entity_type string, entity_id bigint, deleted_at bigint"
SOURCE_TYPES = ("rss", "html")
#: Bytes of a fetched body that are kept; longer ones are cut, without an error.
BODY_LIMIT = 10 << 20


def split_valid_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and the rest with a ``reason``.

    A url is required; the type is rss or html; html needs a scraper config; an interval is above 0 where given.
    """
    reason = (
        F.when(F.coalesce("url", F.lit("")) == "", "url is required")
        .when(~F.coalesce(F.col("type").isin(*SOURCE_TYPES), F.lit(False)), "type must be rss or html")
        .when((F.col("type") == "html") & F.col("scraper_config").isNull(), "html needs scraper_config")
        .when(F.col("poll_interval") <= 0, "poll_interval must be positive")
    )
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def config_to_json(config):
    """The scraper config as stored text; null stays null."""
    return F.to_json(config)


def config_from_json(text):
    return F.from_json(text, SCRAPER_CONFIG)
