"""Answers of polls as a data source: archives of bodies with a header record each, read by source and cut to the byte.

``spark.dataSource.register(Answers)``, then ``df.write.format("answers").option("path", ...)`` and ``spark.read.format("answers")``.
An archive is a row of records: a line of JSON with the fields below and the ``size`` of the packed body, the body packed by zlib, a line end.
This module imports little, as Spark keeps a Python process on the driver for each step of a data source.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import Row, StructType

from tidemark.schema import BODY_LIMIT
from tidemark.sources.files import Folder, Written
from tidemark.tables import BATCH_BYTES, small_batches

FIELDS = ("source_id", "url", "final_url", "status", "etag", "last_modified", "fetched_at", "error")
SCHEMA = "source_id bigint, url string, final_url string, status int, etag string, last_modified string, fetched_at bigint, error string, body binary"
#: Bytes after which a task goes on in another file; files of one read are put together up to as many.
FILE_BYTES = 32 << 20
BUCKETS, SPREAD = 16, 4


def bucket_of(source_id: int | None, buckets: int) -> int:
    return zlib.crc32(str(source_id).encode()) % buckets


class Answers(DataSource):
    """Options: ``path``; ``limit``, bytes of a body that are kept (10 MiB); ``buckets``, files by source, and ``fileBytes`` when writing."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"], schema.names, int(self.options.get("limit", BODY_LIMIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = set(FIELDS + ("body",)) - set(schema.names)
        if missing:
            raise ValueError(f"answers lack {sorted(missing)}")
        return AnswersWriter(self.options["path"], int(self.options.get("buckets", BUCKETS)), int(self.options.get("fileBytes", FILE_BYTES)), overwrite)


class AnswersWriter(DataSourceWriter):
    """A task writes a file for each bucket of sources that it meets; what it wrote counts only once the whole write is committed."""

    def __init__(self, path: str, buckets: int, most: int, overwrite: bool):
        self.path, self.buckets, self.most, self.overwrite = path, buckets, most, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, files, open_ = Folder(self.path), [], {}
        try:
            for row in iterator:
                b = bucket_of(row["source_id"], self.buckets)
                if b not in open_:
                    files.append({"name": f"bucket={b:04d}/{uuid.uuid4().hex}.answers", "bucket": b, "buckets": self.buckets, "rows": 0, "bytes": 0, "lo": None, "hi": None})
                    open_[b] = (folder.create(files[-1]["name"]), files[-1])
                stream, told = open_[b]
                body = None if row["body"] is None else zlib.compress(row["body"], 1)
                head = {k: row[k] for k in FIELDS} | {"size": None if body is None else len(body)}
                record = json.dumps(head, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n" + (body or b"") + b"\n"
                stream.write(record)
                at = row["fetched_at"]
                told |= {"rows": told["rows"] + 1, "bytes": told["bytes"] + len(record)}
                if at is not None:
                    told |= {"lo": at if told["lo"] is None else min(told["lo"], at), "hi": at if told["hi"] is None else max(told["hi"], at)}
                else:
                    told["none"] = True
                if told["bytes"] >= self.most:
                    open_.pop(b)[0].close()
            for stream, _ in open_.values():
                stream.close()
        except BaseException:
            for stream, _ in open_.values():
                stream.close()
            folder.remove(files)
            raise
        return Written(files)

    def commit(self, messages) -> None:
        Folder(self.path).commit([f for m in messages if m for f in m.files], self.overwrite)

    def abort(self, messages) -> None:
        Folder(self.path).remove([f for m in messages if m for f in m.files])


class AnswersReader(DataSourceReader):
    """Only files that can hold an answer of the sources and times asked for are opened; bodies of other sources, or that no column needs, are passed over."""

    def __init__(self, path: str, names: list[str], limit: int):
        self.path, self.names, self.limit = path, names, limit
        self.sources: set | None = None
        self.lo, self.hi = float("-inf"), float("inf")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute == ("source_id",):
                found = set(f.value) if isinstance(f, In) else {f.value}
                self.sources = found if self.sources is None else self.sources & found
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("fetched_at",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.lo = max(self.lo, f.value)
                else:
                    self.hi = min(self.hi, f.value)
            yield f  # times only choose files

    def partitions(self) -> list[InputPartition]:
        bounded = self.lo > float("-inf") or self.hi < float("inf")
        out, names, size = [], [], 0
        for f in Folder(self.path).committed():
            if self.sources is not None and f["bucket"] not in {bucket_of(s, f["buckets"]) for s in self.sources}:
                continue
            if bounded and (f["lo"] is None or f["hi"] < self.lo or f["lo"] > self.hi):
                continue
            names.append(f["name"])
            size += f["bytes"]
            if size >= FILE_BYTES:
                out.append(InputPartition(names))
                names, size = [], 0
        return [*out, InputPartition(names)] if names or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.value:
            yield from self._file(name)

    def _file(self, name: str) -> Iterator[tuple]:
        wanted = "body" in self.names and self.limit > 0
        with Folder(self.path).open(name) as raw:
            f = io.BufferedReader(raw, 1 << 16)
            while line := f.readline():
                head = json.loads(line)
                size = head.pop("size")
                keep = (self.sources is None or head["source_id"] in self.sources) and wanted and size is not None
                body = unpack.decompress(f.read(size), self.limit) if keep and (unpack := zlib.decompressobj()) else None  # the limit is of unpacked bytes
                f.seek(1 if keep else (size or 0) + 1, 1)
                if self.sources is None or head["source_id"] in self.sources:
                    yield tuple(body if n == "body" else head[n] for n in self.names)


class BatchReader(AnswersReader):
    """What Spark reads: the same rows in Arrow batches by bytes. Of rows Spark would gather ten thousand, however large their bodies."""

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        kind = {name: kinds[k] for name, k in (f.split() for f in SCHEMA.split(", "))}
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, kind[n]) for n, x in zip(self.names, zip(*rows, strict=True), strict=True)], names=self.names)
        rows, size = [], 0
        for row in super().read(partition):
            rows.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if size >= BATCH_BYTES:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()


def read_answers(spark, path: str, **options) -> DataFrame:
    """The answers under ``path``; filters by ``source_id`` and ``fetched_at`` choose the files that are opened."""
    spark.dataSource.register(Answers)
    small_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("answers").option("path", path).options(**options).load()


def write_answers(answers: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Writes answers so that a task meets few buckets; a source with many answers is spread over tasks."""
    answers.sparkSession.dataSource.register(Answers)
    small_batches(answers.sparkSession)
    spread = F.pmod(F.xxhash64("url", "fetched_at"), F.lit(SPREAD))
    dealt = answers.select(*(f.split()[0] for f in SCHEMA.split(", "))).repartition(F.pmod(F.xxhash64("source_id"), F.lit(buckets)), spread)
    dealt.write.format("answers").mode(mode).option("path", path).option("buckets", buckets).save()


def body_text(body: Column) -> Column:
    """A body as text; bytes that are no UTF-8, such as a letter that the limit cut, become the replacement character."""
    return F.make_valid_utf8(body.cast("string"))
