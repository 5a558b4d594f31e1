"""Feed tables derived from the supplied parquet tables, for queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.tables import table

T0 = 1704067200


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "region").selectExpr(
        "cast(r_regionkey + 1 as bigint) as id", "r_name as name", "cast(null as bigint) as parent_id", f"cast({T0} + r_regionkey * 3600 as bigint) as updated_at"
    )
    below = table(spark, sf_dir, "nation").selectExpr(
        "cast(100 + n_nationkey as bigint) as id", "n_name as name", "cast(n_regionkey + 1 as bigint) as parent_id", f"cast({T0} + n_nationkey * 7200 as bigint) as updated_at"
    )
    return top.unionByName(below)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", F.expr("cast(substring(source, 4) as bigint)"))
        .selectExpr(
            "n + 1 as id", "if(n % 4 = 3, 'html', 'rss') as type", "concat('http://', source, '.example/feed') as url", "source as title",
            "if(n % 5 = 0, null, 100 + n) as folder_id", f"{T0} + (n * 977) % 86400 as next_poll_at", "n % 12 as consec_fails", "(n % 12) >= 10 as is_dead",
            "cast(3600 as bigint) as poll_interval", f"{T0} + n * 5400 as updated_at",
        )
    )


def items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, before any dedup."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id + 1 as id", "cast(substring(source, 4) as bigint) + 1 as source_id", "sha2(text, 256) as guid", "concat('http://', source, '.example/', doc_id) as url",
        "substring(text, 1, 40) as title", "lang as author", f"{T0} + doc_id * 60 as fetched_at", "text as content_text",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Window.partitionBy("source_id", "guid").orderBy("id")
    return items_raw(spark, sf_dir).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id + 1 as item_id", "toxic = 1 as is_read", "quality = 1 as is_starred", f"{T0} + doc_id * 61 as updated_at")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
        "case event_id % 3 when 0 then 'item' when 1 then 'source' else 'folder' end as entity_type", "user_id as entity_id", f"{T0} + event_id * 60 as deleted_at"
    )


def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as poll outcomes of a source each user: ``source_id, seq, outcome`` in order of time and event."""
    return table(spark, sf_dir, "events").where("event_type <> 'signup'").selectExpr(
        "user_id as source_id", "struct(ts, event_id) as seq", "unix_seconds(cast(ts as timestamp)) as ts",
        "case event_type when 'purchase' then 'new' when 'error' then 'failed' when 'view' then 'none' else 'unchanged' end as outcome",
    )


#: The same for DuckDB.
VIEWS = {
    "v_folders": f"""SELECT (r_regionkey + 1)::BIGINT AS id, r_name AS name, NULL::BIGINT AS parent_id, ({T0} + r_regionkey * 3600)::BIGINT AS updated_at FROM region
      UNION ALL SELECT (100 + n_nationkey)::BIGINT, n_name, (n_regionkey + 1)::BIGINT, ({T0} + n_nationkey * 7200)::BIGINT FROM nation""",
    "v_sources": f"""SELECT n + 1 AS id, CASE WHEN n % 4 = 3 THEN 'html' ELSE 'rss' END AS type, 'http://' || source || '.example/feed' AS url, source AS title,
      CASE WHEN n % 5 = 0 THEN NULL ELSE 100 + n END AS folder_id, {T0} + (n * 977) % 86400 AS next_poll_at, n % 12 AS consec_fails, (n % 12) >= 10 AS is_dead,
      3600::BIGINT AS poll_interval, {T0} + n * 5400 AS updated_at FROM (SELECT DISTINCT source, substring(source, 4)::BIGINT AS n FROM documents)""",
    "v_items_raw": f"""SELECT doc_id + 1 AS id, substring(source, 4)::BIGINT + 1 AS source_id, sha256(text) AS guid, 'http://' || source || '.example/' || doc_id AS url,
      substring(text, 1, 40) AS title, lang AS author, {T0} + doc_id * 60 AS fetched_at, text AS content_text FROM documents""",
    "v_items": "SELECT * FROM v_items_raw QUALIFY row_number() OVER (PARTITION BY source_id, guid ORDER BY id) = 1",
    "v_state": f"SELECT doc_id + 1 AS item_id, toxic = 1 AS is_read, quality = 1 AS is_starred, {T0} + doc_id * 61 AS updated_at FROM labels",
    "v_tomb": f"""SELECT CASE event_id % 3 WHEN 0 THEN 'item' WHEN 1 THEN 'source' ELSE 'folder' END AS entity_type, user_id AS entity_id,
      {T0} + event_id * 60 AS deleted_at FROM events WHERE event_type = 'error'""",
}


def over_views(sql: str) -> str:
    """DuckDB SQL over the views: its own common tables, if any, follow theirs."""
    head = ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items())
    return f"WITH RECURSIVE {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
