"""Streams of poll outcomes and of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.store import upsert_items
from tidemark.plans import poll

STATE = "interval bigint, next_poll_at bigint, fails bigint, dead boolean"


def _last(states: DataFrame) -> DataFrame:
    return states.groupBy("source_id").agg(F.max_by(F.struct("interval", "next_poll_at", "fails", "dead"), "batch").alias("s"))


def last_states(log: DataFrame, out: str) -> DataFrame:
    """Runs a stream ``(source_id, ts, event_id, outcome)`` over all there is and returns the last state of each source.

    Each batch is folded onto the states of the batches before it, a row at a time. ``out`` is a shared folder that holds
    the states and the stream's progress: a later run over the same folder goes on where this one ended.
    """
    spark, store, schema = log.sparkSession, f"{out}/states", f"source_id bigint, {STATE}, batch int"

    def put(batch: DataFrame, n: int) -> None:
        # a batch that is run again is replaced, and starts from only the batches before it
        stored = spark.read.schema(schema).parquet(store).where(F.col("batch") < n) if n else spark.createDataFrame([], schema)
        before = _last(stored).toDF("_source", "before")
        rows = batch.join(before, F.col("source_id").eqNullSafe(F.col("_source")), "left").select("source_id", F.struct("ts", "event_id").alias("seq"), "ts", "outcome", "before")
        poll.fold_polls(rows, f"coalesce(before, {poll.START})").write.mode("overwrite").parquet(f"{store}/batch={n}")

    log.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return _last(spark.read.schema(schema).parquet(store)).select("source_id", "s.*")


def upsert_stream(items: DataFrame, out: str, buckets: int = 64) -> DataFrame:
    """Runs a stream of items into a store under ``out``, first wins by (source_id, guid) also across batches; returns the store.

    The store is partitioned by a hash of the key; a batch is held only against the buckets that its keys fall into. ``out`` is a
    shared folder that also holds the stream's progress: a later run over the same folder goes on where this one ended.
    """
    spark, store, names = items.sparkSession, f"{out}/items", items.columns
    schema = T.StructType([*items.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("source_id", "guid"), F.lit(buckets)).cast("int")).persist()
        try:
            # a batch that is run again is replaced, and sees only the batches before it
            stored = spark.createDataFrame([], schema)
            if n:
                met = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most as many as there are buckets
                stored = spark.read.schema(schema).parquet(store).where((F.col("batch") < n) & F.col("bucket").isin(met))
            upsert_items(stored.select(names), batch.select(*names, "bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={n}")
        finally:
            batch.unpersist()

    items.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(store).select(names)


def collect_changes(changes: DataFrame, out: str) -> DataFrame:
    """Runs a stream of ``sources.changes`` over all there is and returns every change that it and earlier runs over ``out`` delivered, each once."""
    changes.writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return changes.sparkSession.read.schema(changes.schema).parquet(f"{out}/changes")
