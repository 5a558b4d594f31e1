"""Tables as versions under a folder: data is never overwritten, and one small file names what a version consists of."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConcurrentWrite(RuntimeError):
    """Another writer took the version; read the newest one and write again."""


class Versions:
    """The versions of what lies under ``path``: ``_versions/<number>.json`` lists a version's parts, each with the ``name`` of its folder.

    A part is written under a name of its own before any version names it, so a write that fails leaves nothing that a reader or a later writer meets.
    Of two writers only one can create a version's file; the other gets ``ConcurrentWrite``. A file that a lost driver left empty counts as no version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        where, fs = self._at(f"{self.path}/_versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")) if fs.exists(where) else []

    def _parts(self, v: int) -> list[dict] | None:
        where, fs = self._at(f"{self.path}/_versions/{v:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "null")
        except ValueError:
            return None
        finally:
            stream.close()

    def current(self) -> tuple[int, list[dict]]:
        """The number of the version in force, 0 if there is none, and its parts."""
        for v in reversed(self._numbers()):
            parts = self._parts(v)
            if parts is not None:
                return v, parts
        return 0, []

    def fresh(self, kind: str = "data") -> str:
        """A name that no part has."""
        return f"{kind}-{uuid.uuid4().hex}"

    def commit(self, base: int, parts: list[dict]) -> int:
        """Makes ``parts`` the version after ``base``, the version that the writer read."""
        v = max(self._numbers(), default=0) + 1
        if self.current()[0] != base:
            raise ConcurrentWrite(f"version {base} is no longer in force")
        where, fs = self._at(f"{self.path}/_versions/{v:012d}.json")
        try:
            stream = fs.create(where, False)
        except Exception as e:
            raise ConcurrentWrite(f"version {v} is taken") from e
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        return v

    def clean(self, keep: int = 1, older_than: float = 86400.0) -> list[str]:
        """Deletes all but the last ``keep`` versions and the parts that these do not name, if they are ``older_than`` seconds old: younger ones may be of a
        writer that is still at work. Returns the names of the deleted parts."""
        known = [(v, self._parts(v)) for v in self._numbers()]
        good = [(v, parts) for v, parts in known if parts is not None][-keep:]
        held = {p["name"] for _, parts in good for p in parts}
        root, fs = self._at(self.path)
        gone = []
        for s in fs.listStatus(root) if fs.exists(root) else []:
            name = s.getPath().getName()
            if name != "_versions" and name not in held and s.getModificationTime() <= (time.time() - older_than) * 1000:
                fs.delete(s.getPath(), True)
                gone.append(name)
        for v, _ in known:
            if good and v < good[0][0]:
                fs.delete(self._at(f"{self.path}/_versions/{v:012d}.json")[0], False)
        return gone


class Snapshots:
    """A table of which every write is a new version, a folder of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path, Versions(spark, path)

    def version(self) -> int:
        return self.versions.current()[0]

    def read(self, schema: str) -> DataFrame:
        parts = self.versions.current()[1]
        return self.spark.read.parquet(*(f"{self.path}/{p['name']}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, files: int | None = None) -> int:
        """Writes the next version and then points to it; ``files`` compacts. ``ConcurrentWrite`` if another writer came first."""
        base, name = self.version(), self.versions.fresh()
        (df.coalesce(files) if files else df).write.parquet(f"{self.path}/{name}")
        return self.versions.commit(base, [{"name": name}])

    def clean(self, keep: int = 1, older_than: float = 86400.0) -> list[str]:
        """Removes the data of all but the last ``keep`` versions, and of writes that failed."""
        return self.versions.clean(keep, older_than)
