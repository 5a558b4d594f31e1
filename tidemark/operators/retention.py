"""Items by the day they were fetched: a sweep drops days or rewrites them, and touches no other; with its counts from the same job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.store import purge_tombstones, tombstones_for
from tidemark.sources.snapshots import Snapshots, Versions

DAY = 86400


class DayStore:
    """Items ``(id, fetched_at, ...)`` under ``path``, a folder for each day; a version names the days that it has, and how many items each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path, Versions(spark, path)

    def _written(self, items: DataFrame) -> list[dict]:
        """Writes items as folders by day, in one job that counts them as well."""
        name = self.versions.fresh()
        items.withColumn("day", F.floor(F.col("fetched_at") / DAY).cast("bigint")).repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("day").parquet(f"{self.path}/{name}")
        got = self.spark.read.schema("day bigint").parquet(f"{self.path}/{name}").groupBy("day").count().collect()  # a row a day
        return [{"name": name, "day": r.day, "n": r["count"]} for r in sorted(got)]

    def add(self, items: DataFrame) -> int:
        base, parts = self.versions.current()
        return self.versions.commit(base, [*parts, *self._written(items)])

    def _read(self, parts: list[dict], schema: str) -> DataFrame:
        folders = [f"{self.path}/{p['name']}/day={p['day']}" for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, schema: str) -> DataFrame:
        return self._read(self.versions.current()[1], schema)

    def days(self) -> list[int]:
        return sorted({p["day"] for p in self.versions.current()[1]})

    def sweep(self, states: DataFrame, before: int, now: int, schema: str) -> tuple[DataFrame, int]:
        """Removes items fetched before ``before`` that are not starred; returns a tombstone for each, as written, and their number.

        Only days that begin before ``before`` are read. One job splits their items, writes those that stay and marks, and counts both on the way; days of which nothing
        stays are no longer named. Items of other days are neither read nor written.
        """
        base, parts = self.versions.current()
        old = [p for p in parts if p["day"] * DAY < before]
        starred = states.where("is_starred").select(F.col("item_id").alias("id"), F.lit(True).alias("_starred")).distinct()
        judged = self._read(old, schema).join(starred, "id", "left").withColumn("_gone", (F.col("fetched_at") < before) & F.col("_starred").isNull()).drop("_starred")
        seen, name = Observation(), self.versions.fresh()
        observed = judged.observe(seen, F.count_if("_gone").alias("swept"), F.count_if(~F.col("_gone")).alias("kept"))
        observed.withColumn("day", F.floor(F.col("fetched_at") / DAY).cast("bigint")).write.partitionBy("_gone", "day").parquet(f"{self.path}/{name}")
        swept = seen.get["swept"]
        stay = self.spark.read.schema("_gone boolean, day bigint").parquet(f"{self.path}/{name}").where("not _gone").groupBy("day").count().collect() if seen.get["kept"] else []
        kept = [{"name": f"{name}/_gone=false", "day": r.day, "n": r["count"]} for r in stay]
        gone = self.spark.read.schema("id bigint").parquet(f"{self.path}/{name}/_gone=true") if swept else self.spark.createDataFrame([], "id bigint")
        marks = tombstones_for("item", gone.select("id"), now)
        if swept:
            self.versions.commit(base, [*(p for p in parts if p not in old), *kept])
        return marks, swept


def retain(items: DayStore, states: Snapshots, tombstones: Snapshots, now: int, item_cutoff: int, mark_cutoff: int, schemas: tuple[str, str, str]) -> dict[str, int]:
    """One round of retention: the sweep, its tombstones, the states of swept items, old tombstones, and what no version names any more.

    ``schemas`` are those of items, states and tombstones. Returns the numbers of ``swept`` items and ``purged`` tombstones, from the jobs that wrote.
    """
    marks, swept = items.sweep(states.read(schemas[1]), item_cutoff, now, schemas[0])
    if swept:
        held = states.read(schemas[1])
        states.write(held.join(marks.select(F.col("entity_id").alias("item_id")), "item_id", "left_anti").select(held.columns))
    old, seen = tombstones.read(schemas[2]), Observation()
    told = old.observe(seen, F.count_if(F.col("deleted_at") < mark_cutoff).alias("purged"))
    tombstones.write(purge_tombstones(told, mark_cutoff).unionByName(marks.select(*(c for c in old.columns if c in marks.columns)), allowMissingColumns=True))
    for table in (states, tombstones):
        table.clean()
    return {"swept": swept, "purged": seen.get["purged"]}
