"""Records as JSON: bodies to rows of the store's tables, and rows to lines as clients get them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import FOLDERS, ITEMS, SOURCES, STATES

SCHEMAS = {"sources": SOURCES, "folders": FOLDERS, "items": ITEMS, "states": STATES}
#: Columns that clients do not get, and those that a line leaves out where they are null.
HIDDEN = ("etag", "last_modified", "content_text")
OPTIONAL = ("folder_id", "scraper_config", "last_poll_at", "parent_id", "read_at", "starred_at")


def parsed(rows: DataFrame, kind: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Bodies to records of the given kind, with the rows' other columns, and the rows of which the body is no JSON object of it.

    Unknown fields are ignored and missing ones null; a null or empty body is malformed, and so is one with a number, boolean, list or object where text is due.
    """
    texts = [f.strip().split(" ")[0] for f in _top_fields(SCHEMAS[kind]) if f.strip().split(" ")[1] == "string"]
    value = F.try_parse_json(body)
    wrong = [~F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{c}", "variant")).isin("STRING", "VOID"), F.lit(True)) for c in texts]
    got = rows.withColumn("_r", F.from_json(body, f"{SCHEMAS[kind]}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.coalesce(F.trim(F.col(body)).startswith("{"), F.lit(False)) | reduce(lambda x, y: x | y, wrong, F.lit(False))
    rest = [c for c in rows.columns if c != body]
    fields = [f.strip().split(" ")[0] for f in _top_fields(SCHEMAS[kind])]
    return got.where(~bad).select(*rest, *(F.col(f"_r.{f}").alias(f) for f in fields)), got.where(bad).select(rows.columns)


def _top_fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        out.append("") if c == "," and not depth else out.__setitem__(-1, out[-1] + c)
    return out


def line(df: DataFrame) -> Column:
    """A row as a JSON object: all columns but the hidden ones, optional ones only where they have a value, others as null where they have none."""
    shown = [c for c in df.columns if c not in HIDDEN]
    fields = []
    for c in shown:
        one = F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"})
        field = F.substring(one, F.lit(2), F.length(one) - 2)  # without the braces
        fields.append(F.when(F.col(c).isNotNull(), field) if c in OPTIONAL else field)
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def error_line(message: Column) -> Column:
    """The object that a client gets for an error."""
    return F.to_json(F.struct(F.coalesce(message, F.lit("")).alias("error")))


def lines(df: DataFrame) -> DataFrame:
    """One column ``value`` of JSON lines, to be written as text."""
    return df.select(line(df).alias("value"))
