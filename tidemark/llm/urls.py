"""URL filtering: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Where no rule fits, hosts with one of these labels are blocked, all else is allowed.
SPAM = ("cheap-pills", "spam-farm")
#: The rule index is sent to every executor while it has at most so many rows; beyond, it is joined by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Pattern:
    """A rule: its name (null for a default of the method), verdict, regular expression over host
    and path, the whole tokens that every match contains, and its rank (the greater wins)."""

    name: str | None
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(verdict: str, text: str) -> Pattern:
    """A host with all its subdomains, and a path prefix. ``net/`` is host ``net``, path ``/``."""
    host, _, path = text.partition("/")
    path = "/" + path
    whole = path.split("/")[1:-1]
    return Pattern(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*host.split("."), *whole), len(text))


def label_rule(label: str) -> Pattern:
    """A default: block hosts of which a label is ``label``."""
    return Pattern(None, "block", rf"^(?:[^/]*\.)?{re.escape(label)}(?:\.[^/]*)?(?:/|$)", (label,), 0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, patterns: list[Pattern], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every url: ``id_col, host, path, rule, verdict``.

    A rule is filed under the one of its tokens that the fewest urls have, counted over all urls.
    A url's distinct tokens fetch the rules filed under them, and only those rules' expressions run
    on it; rules without a whole token are filed under the empty token, which every url has. The
    greatest rank wins, then the rule's name. A null or empty url, or one without ``://``, has an
    empty host and path; it fits no rule and is allowed. Rows that repeat stay repeated: they are
    told apart by a row number made in the scan.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split("host", r"\."), F.split("path", "/")))
    distinct = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    wanted = sorted({t for p in patterns for t in p.tokens})
    seen = {
        r.token: r.n
        for r in distinct.select("n", F.explode(tokens).alias("token")).where(F.col("token").isin(wanted))
        .groupBy("token").agg(F.sum("n").alias("n")).collect()
    } if wanted else {}
    filed = [
        (min(p.tokens, key=lambda t: (seen.get(t, 0), t)) if p.tokens else "", p.name, p.verdict, p.regex, p.rank)
        for p in patterns
    ]
    index = spark.createDataFrame(filed, "token string, rule string, verdict string, regex string, rank int")
    if len(filed) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fits = (
        distinct.select("host", "path", F.explode(tokens).alias("token")).join(index, "token")
        .where("rlike(concat(host, path), regex)")
        .groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    )
    return urls.join(fits, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict under the fixed rules and the spam defaults."""
    from tidemark.tables import table

    return judge(table(spark, sf_dir, "pages"), [host_rule(v, t) for v, t in RULES] + [label_rule(x) for x in SPAM])


OP8_SQL = """
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/'))
SELECT page_id, host, path,
  (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
    CASE WHEN list_has_any(string_split(host, '.'), ['cheap-pills', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM u
"""
