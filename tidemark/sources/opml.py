"""Outline files: import to folders and sources, export of both."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.store import numbered

_LEAF = "_text: string, _title: string, _type: string, _xmlUrl: string"
SCHEMA = f"body struct<outline: array<struct<{_LEAF}, outline: array<struct<{_LEAF}>>>>>, _corrupt string"


def is_feed(o: Column) -> Column:
    """An outline with an xmlUrl, or of type rss or atom in any case."""
    return (F.coalesce(o["_xmlUrl"], F.lit("")) != "") | F.lower(F.coalesce(o["_type"], F.lit(""))).isin("rss", "atom")


def name_of(o: Column) -> Column:
    return F.coalesce(F.nullif(o["_title"], F.lit("")), o["_text"], F.lit(""))


def outlines(files: DataFrame) -> DataFrame:
    """Top outlines of ``files(file, body)``: ``file, place, o``."""
    parsed = F.from_xml(F.col("body"), SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    return files.select("file", F.posexplode(parsed.getField("body").getField("outline")).alias("place", "o"))


def imported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders ``(file, place, name)`` and feeds ``(file, place, sub, url, title, in_folder)``.

    An outline that is no feed is a folder, whether its name exists or not; what lies below a
    folder's own outlines is dropped. A feed without an xmlUrl has a null url.
    """
    tops = outlines(files).withColumn("feed", is_feed(F.col("o")))
    folders = tops.where(~F.col("feed")).select("file", "place", name_of(F.col("o")).alias("name"))
    row = lambda o, inside: (F.nullif(o["_xmlUrl"], F.lit("")).alias("url"), F.coalesce(F.nullif(name_of(o), F.lit("")), o["_xmlUrl"]).alias("title"), F.lit(inside).alias("in_folder"))
    flat = tops.where("feed").select("file", "place", F.lit(-1).alias("sub"), *row(F.col("o"), False))
    nested = tops.where(~F.col("feed")).select("file", "place", F.posexplode("o.outline").alias("sub", "s")).where(is_feed(F.col("s"))).select("file", "place", "sub", *row(F.col("s"), True))
    return folders, flat.unionByName(nested)


def import_counts(files: DataFrame, known: DataFrame) -> DataFrame:
    """``file, folders_created, sources_created, skipped``: a feed is skipped without a url, or with one that is stored or came before."""
    from pyspark.sql import Window

    folders, feeds = imported(files)
    order = Window.partitionBy("file", "url").orderBy("place", "sub")
    judged = feeds.withColumn("k", F.row_number().over(order)).join(known.select("url", F.lit(True).alias("stored")).distinct(), "url", "left")
    made = F.col("url").isNotNull() & (F.col("k") == 1) & F.col("stored").isNull()
    per_feed = judged.groupBy("file").agg(F.count_if(made).alias("sources_created"), F.count_if(~made).alias("skipped"))
    per_folder = folders.groupBy("file").agg(F.count("*").alias("folders_created"))
    return files.select("file").join(per_folder, "file", "left").join(per_feed, "file", "left").na.fill(0).select("file", "folders_created", "sources_created", "skipped")


def _escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def outline_of(title: Column, url: Column, kind: Column) -> Column:
    """A source as an outline; html sources have no type."""
    return F.concat(F.lit('<outline text="'), _escape(title), F.lit('" title="'), _escape(title), F.when(kind == "rss", '" type="rss').otherwise(""), F.lit('" xmlUrl="'), _escape(url), F.lit('"/>'))


def grouped(sources: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders that have a source: ``folder, titles, urls``, sources by title; nesting is flattened."""
    both = sources.join(folders.select(F.col("id").alias("folder_id"), "name"), "folder_id")
    per = both.groupBy("folder_id", "name").agg(F.array_sort(F.collect_list(F.struct("title", "url"))).alias("s"))
    return per.select("folder_id", F.col("name").alias("folder"), F.array_join("s.title", ",").alias("titles"), F.array_join("s.url", ",").alias("urls"))


def export(sources: DataFrame, folders: DataFrame) -> DataFrame:
    """The lines of an outline file in order: ``section, rank, line``; sources without a folder first, then folders by name."""
    line = outline_of(F.col("title"), F.col("url"), F.col("type"))
    left = sources.join(folders.select(F.col("id").alias("folder_id"), "name"), "folder_id", "left")
    loose = left.where("name is null").select(F.lit(0).alias("section"), F.col("title").alias("rank"), line.alias("line"))
    per = left.where("name is not null").groupBy("folder_id", "name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("title", line.alias("line")))).getField("line"), "").alias("in"))
    boxed = per.select(F.lit(1).alias("section"), F.col("name").alias("rank"), F.concat(F.lit('<outline text="'), _escape(F.col("name")), F.lit('" title="'), _escape(F.col("name")), F.lit('">'), F.col("in"), F.lit("</outline>")).alias("line"))
    return loose.unionByName(boxed)


def document(lines: DataFrame, title: str) -> DataFrame:
    """One row ``xml``: the whole outline file of a store's sources, which are few."""
    body = lines.agg(F.array_join(F.array_sort(F.collect_list(F.struct("section", "rank", "line"))).getField("line"), "").alias("body"))
    return body.select(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><opml version="2.0"><head><title>{title}</title></head><body>'), "body", F.lit("</body></opml>")).alias("xml"))


def ordered_lines(sources: DataFrame, folders: DataFrame) -> DataFrame:
    """The lines of an outline file in order, one column ``line``: no row gathers a folder's or the file's lines.

    Sources without a folder come first, by title; then folders that have a source, by name, each with an opening line, its sources by title, and a closing line.
    """
    line = outline_of(F.col("title"), F.col("url"), F.col("type"))
    left = sources.select(F.col("id").alias("sid"), "title", "url", "type", "folder_id").join(folders.select(F.col("id").alias("folder_id"), "name"), "folder_id", "left")
    key = ("section", "name", "folder", "part", "title", "sid")
    lone = left.where("name is null").select(F.lit(0).alias("section"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("folder"), F.lit(1).alias("part"), "title", "sid", line.alias("line"))
    inside = left.where("name is not null").select(F.lit(1).alias("section"), "name", F.col("folder_id").alias("folder"), F.lit(1).alias("part"), "title", "sid", line.alias("line"))
    boxes = inside.select("section", "name", "folder").distinct()
    head = F.concat(F.lit('<outline text="'), _escape(F.col("name")), F.lit('" title="'), _escape(F.col("name")), F.lit('">'))
    ends = [boxes.select("section", "name", "folder", F.lit(part).alias("part"), F.lit("").alias("title"), F.lit(0).cast("bigint").alias("sid"), text.alias("line")) for part, text in ((0, head), (2, F.lit("</outline>")))]
    return lone.unionByName(inside).unionByName(ends[0]).unionByName(ends[1]).orderBy(*key).select("line")


def write_document(sources: DataFrame, folders: DataFrame, path: str, title: str) -> None:
    """Writes a store's outline file as ordered files, which one after another are the document."""
    from tidemark.sources.text_files import write_text

    head = f'<?xml version="1.0" encoding="UTF-8"?><opml version="2.0"><head><title>{escape(title)}</title></head><body>'
    write_text(ordered_lines(sources, folders), path, head, "</body></opml>")


def import_into(sources: DataFrame, folders: DataFrame, files: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after ``files(file, body)`` came in, one after another by ``file``: sources, folders, and the feeds that were skipped, with a ``reason``.

    Folders get ids after the greatest, in order of file and place; their feeds get these as ``folder_id``. A feed without a url, with a stored one, or with one that came before
    it (first those outside of folders, then folder by folder) is skipped.
    """
    made, feeds = imported(files)
    top = folders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
    placed = numbered(made, top, "file", "place")
    stamps = {c: F.lit(now).cast("bigint") for c in ("created_at", "updated_at")}
    fresh = placed.select("id", "name", F.lit(None).cast("bigint").alias("parent_id")).withColumns(stamps)
    rows = feeds.join(placed.select("file", "place", F.col("id").alias("folder_id"), F.lit(True).alias("in_folder")), ["file", "place", "in_folder"], "left")
    order = F.struct("file", F.col("in_folder").cast("int"), "place", "sub")
    first = Window.partitionBy("url").orderBy(order)
    judged = rows.withColumn("order", order).withColumn("k", F.row_number().over(first)).join(sources.select("url", F.lit(True).alias("stored")).distinct(), "url", "left").withColumn(
        "reason", F.when(F.col("url").isNull(), "no url").when(F.col("stored"), "stored already").when(F.col("k") > 1, "came before"))
    highest = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
    new = numbered(judged.where("reason is null"), highest, "order").select(
        "id", F.lit("rss").alias("type"), "url", "title", "folder_id", F.lit(now).cast("bigint").alias("next_poll_at"), F.lit(3600).cast("bigint").alias("poll_interval"), F.lit(0).alias("consec_fails"), F.lit(False).alias("is_dead")
    ).withColumns(stamps)
    keep = lambda df, like: df.select(*(F.col(c).cast(like.schema[c].dataType) for c in like.columns if c in df.columns))
    return sources.unionByName(keep(new, sources), allowMissingColumns=True), folders.unionByName(keep(fresh, folders), allowMissingColumns=True), judged.where("reason is not null").select("file", "place", "sub", "url", "title", "reason")
