"""First-wins keys without a bound in time: sorted runs of keys with Bloom filters, so that a batch reads what may hold its keys and nothing else."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.store import first_of_batch
from tidemark.sources.snapshots import Versions

#: Keys of a slice of a run, about; bits of a filter for each key; bits that a key sets.
SLICE, BITS, HASHES = 1 << 15, 16, 4
#: Slices that a batch may name one by one to the scan of a run; beyond, the run is read whole, as the batch is then large itself.
NAMED = 200


def slice_bits(n: int) -> int:
    """Leading bits of the hash by which ``n`` keys fall into slices."""
    return max(0, math.ceil(math.log2(max(1, n) / SLICE)))


def slice_of(h, bits: int):
    """The slice of a hash column."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _places(h: np.ndarray, m: int) -> np.ndarray:
    """``HASHES`` places below ``m``, a power of two, for each hash."""
    u = h.astype(np.int64).view(np.uint64)
    step = (u * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) | np.uint64(1)
    return ((u[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(m - 1)).astype(np.int64)


def bloom(h: np.ndarray) -> bytes:
    """A filter of about ``BITS`` bits a key."""
    m = 1 << max(6, math.ceil(math.log2(BITS * max(1, len(h)))))
    bits = np.zeros(m, bool)
    bits[_places(h, m).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(h: np.ndarray, made: bytes) -> np.ndarray:
    """Which of the hashes the filter may have seen; never misses one that it has."""
    bits = np.unpackbits(np.frombuffer(made, np.uint8)).astype(bool)
    return bits[_places(h, len(bits))].all(1)


def _filters(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "filter": [bloom(frame["h"].to_numpy())]})


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(filters):
        return keys.iloc[:0]
    return keys[may_hold(keys["h"].to_numpy(), filters["filter"].iloc[0])]


class KeyRuns:
    """The keys ``(source_id, guid)`` under ``path``: runs sorted by hash, each with a Bloom filter for every slice of hashes.

    ``fan`` runs of a level become one of the next, so each key is rewritten a logarithmic number of times and a batch asks as many runs. Of a run, a batch reads the
    filters of the slices that its keys fall into, and the keys of slices whose filter says yes. ``reads`` tells for each batch how many runs there were, how many were read, and the
    keys that those slices hold, about. What a batch did is one version: a batch that is run again changes nothing.
    """

    def __init__(self, spark, path: str, fan: int = 8):
        self.spark, self.path, self.fan, self.versions, self.reads = spark, path, fan, Versions(spark, path), []

    def _put(self, keys: DataFrame, n: int, level: int) -> dict:
        """Writes a run of ``n`` keys ``(h, source_id, guid)``, each once."""
        name, bits = f"run-{uuid.uuid4().hex}", slice_bits(n)
        rows = keys.withColumn("slice", slice_of(F.col("h"), bits))
        parts = max(1, n // (8 * SLICE))
        rows = rows.repartitionByRange(parts, "slice", "h") if parts > 1 else rows.coalesce(1)
        rows.sortWithinPartitions("slice", "h").write.parquet(f"{self.path}/{name}/keys")
        stored = self.spark.read.schema("h bigint, slice int").parquet(f"{self.path}/{name}/keys")
        stored.groupBy("slice").applyInPandas(_filters, "slice int, filter binary").sort("slice").write.parquet(f"{self.path}/{name}/filters")
        return {"name": name, "level": level, "n": n, "bits": bits}

    def _keys(self, run: dict) -> DataFrame:
        return self.spark.read.schema("h bigint, source_id bigint, guid string, slice int").parquet(f"{self.path}/{run['name']}/keys")

    def _known(self, keys: DataFrame, runs: list[dict], kept: list[DataFrame]) -> DataFrame | None:
        """Those of ``keys`` that a run holds; ``kept`` gets what is to be unpersisted after."""
        found, read, held = [], 0, 0
        for run in runs:
            own = keys.withColumn("slice", slice_of(F.col("h"), run["bits"]))
            met = [r.slice for r in own.select("slice").distinct().limit(NAMED + 1).collect()]
            filters = self.spark.read.schema("slice int, filter binary").parquet(f"{self.path}/{run['name']}/filters")
            if len(met) <= NAMED:
                filters = filters.where(F.col("slice").isin(met))
            maybe = own.groupBy("slice").cogroup(filters.groupBy("slice")).applyInPandas(_probe, own.schema).persist()
            kept.append(maybe)
            hit = [r.slice for r in maybe.select("slice").distinct().limit(NAMED + 1).collect()]
            if hit:
                stored = self._keys(run)
                if len(hit) <= NAMED:
                    stored = stored.where(F.col("slice").isin(hit))
                read, held = read + 1, held + min(run["n"], len(hit) * (run["n"] >> run["bits"]) if len(hit) <= NAMED else run["n"])
                found.append(maybe.join(stored.select("h", "source_id", "guid"), ["h", "source_id", "guid"], "left_semi").select("h", "source_id", "guid"))
        self.reads.append((len(runs), read, held))
        out = None
        for df in found:
            out = df if out is None else out.unionByName(df)
        return out

    def add(self, batch: DataFrame, n: int, items: str) -> None:
        """Stores under ``items`` the first row of each key of ``batch`` that no run holds, as batch ``n``, and their keys as a run."""
        base, parts = self.versions.current()
        if any(p["level"] < 0 and p["batch"] >= n for p in parts):
            return
        runs = [p for p in parts if p["level"] >= 0]
        first = first_of_batch(batch, ["source_id", "guid"], "id").withColumn("h", F.xxhash64("source_id", "guid")).persist()
        kept = [first]
        try:
            known = self._known(first.select("h", "source_id", "guid"), runs, kept)
            fresh = first if known is None else first.join(known, ["h", "source_id", "guid"], "left_anti")
            fresh.select(*batch.columns, "h").write.mode("overwrite").parquet(f"{items}/batch={n}")
            stored = self.spark.read.schema("h bigint, source_id bigint, guid string").parquet(f"{items}/batch={n}")
            count = stored.count()
            runs = [*runs, *([self._put(stored, count, 0)] if count else [])]
            runs = self._merged(runs)
            self.versions.commit(base, [{"name": "", "level": -1, "batch": n}, *runs])
        finally:
            for df in kept:
                df.unpersist()

    def _merged(self, runs: list[dict]) -> list[dict]:
        level = 0
        while level <= max((r["level"] for r in runs), default=-1):
            own = [r for r in runs if r["level"] == level]
            if len(own) >= self.fan:
                both = self._keys(own[0]).drop("slice")
                for r in own[1:]:
                    both = both.unionByName(self._keys(r).drop("slice"))
                runs = [r for r in runs if r["level"] != level] + [self._put(both, sum(r["n"] for r in own), level + 1)]
            level += 1
        return runs


def upsert_by_runs(items: DataFrame, out: str, fan: int = 8) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Runs a stream of items into a store under ``out``, first wins by (source_id, guid) also across batches; returns the store and what batches read (``KeyRuns.reads``).

    Reads follow the batches: a batch of new keys reads no run but for the filters' rare errors. ``out`` is a shared folder that also holds the stream's progress.
    """
    spark, runs = items.sparkSession, KeyRuns(items.sparkSession, f"{out}/keys", fan)
    items.writeStream.foreachBatch(lambda batch, n: runs.add(batch, n, f"{out}/items")).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*items.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{out}/items").select(items.columns), runs.reads
