"""Ordered text files as a sink: lines of JSON, or the lines of an outline file between its head and tail.

``spark.dataSource.register(OrderedText)``; ``df.write.format("ordered_text")`` takes one column of lines in the order of ``df``.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import Row, StructType

from tidemark.sources.files import Folder, Written


class OrderedText(DataSource):
    """Options: ``path``; ``head`` and ``tail``, lines around those of a write."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> str:
        return "place bigint, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TextReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TextWriter(self.options["path"], self.options.get("head", ""), self.options.get("tail", ""), overwrite)


class TextWriter(DataSourceWriter):
    """A file for each partition; their order is that of the partitions, kept in the list that the commit writes. A task that fails removes its file."""

    def __init__(self, path: str, head: str, tail: str, overwrite: bool):
        self.path, self.head, self.tail, self.overwrite = path, head, tail, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        place, folder = TaskContext.get().partitionId(), Folder(self.path)
        told = {"name": f"{place:06d}-{uuid.uuid4().hex}.txt", "place": place, "lines": 0}
        out = None
        try:
            for row in iterator:
                out = out or folder.create(told["name"])
                out.write((row[0] or "").encode("utf-8", "surrogatepass") + b"\n")
                told["lines"] += 1
            if out:
                out.close()
        except BaseException:
            if out:
                out.close()
            folder.remove([told])
            raise
        return Written([told] if out else [])

    def commit(self, messages) -> None:
        folder, ends = Folder(self.path), []
        for place, text in ((-1, self.head), (1 << 40, self.tail)):
            if text:
                ends.append({"name": f"{'head' if place < 0 else 'tail'}-{uuid.uuid4().hex}.txt", "place": place, "lines": 1})
                with folder.create(ends[-1]["name"]) as f:
                    f.write(text.encode() + b"\n")
        files = sorted([*ends, *(f for m in messages if m for f in m.files)], key=lambda f: f["place"])
        folder.commit(files, self.overwrite)

    def abort(self, messages) -> None:
        Folder(self.path).remove([f for m in messages if m for f in m.files])


class TextReader(DataSourceReader):
    """Lines with their ``place`` in the whole, a partition for each file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out, begin = [], 0
        for f in Folder(self.path).committed():
            out.append(InputPartition((f["name"], begin)))
            begin += f["lines"]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        name, begin = partition.value
        with Folder(self.path).open(name) as raw:
            for k, line in enumerate(io.BufferedReader(raw, 1 << 16)):
                yield begin + k, line[:-1].decode("utf-8", "surrogatepass")


def write_text(lines: DataFrame, path: str, head: str = "", tail: str = "", mode: str = "overwrite") -> None:
    """Writes the first column of ``lines``, which are in order; line ends within a line are the writer's concern."""
    lines.sparkSession.dataSource.register(OrderedText)
    lines.write.format("ordered_text").mode(mode).option("path", path).option("head", head).option("tail", tail).save()


def read_text(spark, path: str) -> DataFrame:
    """``place, value``: the lines of the last whole write and of those appended to it."""
    spark.dataSource.register(OrderedText)
    return spark.read.format("ordered_text").option("path", path).load()
