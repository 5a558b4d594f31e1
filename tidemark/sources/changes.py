"""The change feed of a store as a data source: one read of all that changed after a cursor, or a stream with the cursor as its offset.

A store is a folder of ``Snapshots`` tables. Parts of Parquet files are chosen by the least and greatest change time in their footers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.files import Folder
from tidemark.sources.records import HIDDEN, OPTIONAL

#: Tables of a store, the column that says when a row changed, and the one that names it.
ARMS = {"items": ("fetched_at", "id"), "states": ("updated_at", "item_id"), "folders": ("updated_at", "id"), "sources": ("updated_at", "id"), "tombstones": ("deleted_at", "entity_id")}
SCHEMA = "kind string, id bigint, changed_at bigint, line string"
#: Rows of row groups that make one partition, at least.
ROWS = 1 << 18


def cursor_of(since: int | str | None) -> int:
    """A cursor as clients give it: a whole number of 64 bits; none or an empty text is 0."""
    text = "" if since is None else str(since)
    if text and not re.fullmatch(r"[+-]?[0-9]+", text) or not -(1 << 63) <= int(text or 0) < 1 << 63:
        raise ValueError("since must be a whole number of seconds")
    return int(text or 0)


class Changes(DataSource):
    """Options: ``path``; ``since``, a cursor (0); ``hold``, seconds before the newest change that a stream waits for late writes (0)."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return SCHEMA

    def _feed(self) -> _Feed:
        return _Feed(self.options["path"], cursor_of(self.options.get("since")), int(self.options.get("hold", 0)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChangesReader(self._feed())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangesStream(self._feed())


class _Feed:
    def __init__(self, path: str, since: int, hold: int):
        self.path, self.since, self.hold = path, since, hold

    def parts(self) -> dict[str, list[str]]:
        """The folders of each table's version in force."""
        folder, out = Folder(self.path), {}
        for kind in ARMS:
            out[kind] = []
            for name in reversed(folder.names(f"{kind}/_versions")):
                try:
                    out[kind] = [p["name"] for p in json.loads(folder.text(f"{kind}/_versions/{name}"))]
                    break
                except ValueError:  # a lost driver's empty file
                    continue
        return out

    def groups(self, parts: dict[str, list[str]]) -> Iterator[tuple[str, str, int, int, int | None, int | None]]:
        """Row groups with their rows, and their least and greatest change, from the footers alone."""
        folder = Folder(self.path)
        for kind, names in parts.items():
            change = ARMS[kind][0]
            for part in names:
                for name in folder.names(f"{kind}/{part}"):
                    if not name.endswith(".parquet"):
                        continue
                    with folder.open(f"{kind}/{part}/{name}") as f:
                        meta = pq.ParquetFile(f).metadata
                    at = meta.schema.names.index(change)
                    for g in range(meta.num_row_groups):
                        s = meta.row_group(g).column(at).statistics
                        known = s is not None and s.has_min_max
                        yield kind, f"{kind}/{part}/{name}", g, meta.row_group(g).num_rows, s.min if known else None, s.max if known else None

    def newest(self, parts: dict[str, list[str]]) -> int:
        return max((hi for *_, hi in self.groups(parts) if hi is not None), default=self.since)

    def plan(self, parts: dict[str, list[str]], start: int, end: int) -> list[InputPartition]:
        out, held, n = [], [], 0
        for kind, name, g, rows, lo, hi in self.groups(parts):
            if hi is not None and (hi <= start or lo > end):
                continue
            held.append((kind, name, g))
            n += rows
            if n >= ROWS:
                out.append(InputPartition((held, start, end)))
                held, n = [], 0
        return out + ([InputPartition((held, start, end))] if held else [])

    def rows(self, partition: InputPartition) -> Iterator[tuple]:
        held, start, end = partition.value
        folder = Folder(self.path)
        for kind, name, g in held:
            change, key = ARMS[kind]
            with folder.open(name) as f:
                file = pq.ParquetFile(f)
                shown = [c for c in file.schema_arrow.names if c not in HIDDEN]
                for batch in file.iter_batches(4096, row_groups=[g], columns=shown):
                    at = batch.column(shown.index(change))
                    for row in batch.filter(pc.and_(pc.greater(at, start), pc.less_equal(at, end))).to_pylist():
                        yield kind, row[key], row[change], json.dumps({k: v for k, v in row.items() if v is not None or k not in OPTIONAL}, ensure_ascii=False, separators=(",", ":"))


class ChangesReader(DataSourceReader):
    """All that changed after ``since``, in one version of every table."""

    def __init__(self, feed: _Feed):
        self.feed = feed

    def partitions(self) -> list[InputPartition]:
        return self.feed.plan(self.feed.parts(), self.feed.since, 1 << 62) or [InputPartition(([], 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.feed.rows(partition)


class ChangesStream(DataSourceStreamReader):
    """Offsets are the cursor and the parts of each table it was read from, so a batch that runs again reads what it read before."""

    def __init__(self, feed: _Feed):
        self.feed = feed

    def initialOffset(self) -> dict:
        return {"cursor": self.feed.since, "parts": "{}"}

    def latestOffset(self) -> dict:
        parts = self.feed.parts()
        return {"cursor": max(self.feed.since, self.feed.newest(parts) - self.feed.hold), "parts": json.dumps(parts)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["cursor"] <= start["cursor"]:
            return []
        return self.feed.plan(json.loads(end["parts"]), start["cursor"], end["cursor"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.feed.rows(partition)


def read_changes(spark, path: str, since: int | str | None = None) -> DataFrame:
    """``kind, id, changed_at, line`` of all rows that changed after ``since``, deletions as rows of ``tombstones``; the next cursor is the greatest ``changed_at``."""
    spark.dataSource.register(Changes)
    return spark.read.format("changes").option("path", path).option("since", cursor_of(since)).load()


def stream_changes(spark, path: str, since: int | str | None = None, hold: int = 0) -> DataFrame:
    """The same as a stream: each batch has what changed since the one before, and a stream that is resumed goes on at its cursor."""
    spark.dataSource.register(Changes)
    return spark.readStream.format("changes").option("path", path).option("since", cursor_of(since)).option("hold", hold).load()
