"""Due sources as a stream: the state of every source with a timer at its next poll."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.poll import DEAD_AT, step

_STATE = "interval bigint, next_poll_at bigint, fails bigint, dead boolean, folded bigint"
OUTPUT = "source_id bigint, kind string, at bigint, interval bigint, next_poll_at bigint, fails bigint, dead boolean"


class PollTimers(StatefulProcessor):
    """Folds the polls of a source into its state and tells when it is due.

    Each poll moves the one timer of its source to the new ``next_poll_at``. When the time of the stream passes it, a row ``due`` is put out and no timer is
    left until the next poll is told. A source that dies has no timer any more, and its state is a mark, so later polls of it change
    nothing. Every batch in which a source was polled puts out a row ``state``, counted by ``at``. The polls of a source in one batch are in memory together.
    """

    def __init__(self, dead_at: int = DEAD_AT):
        self.dead_at = dead_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.timer = handle.getValueState("timer", "at bigint")

    def _move(self, at: int | None) -> None:
        old = self.timer.get()
        if old is not None:
            self.handle.deleteTimer(old[0] * 1000)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at * 1000)
            self.timer.update((at,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        dead = bool(row["dead"])
        self.state.update((int(row["interval"]), int(row["next_poll_at"]), int(row["fails"]), dead, 0))
        if not dead:
            self._move(int(row["next_poll_at"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        *state, folded = held if held is not None else (3600, 0, 0, False, 0)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")  # a shuffle keeps no order
        for ts, outcome in zip(batch["ts"].tolist(), batch["outcome"].tolist(), strict=True):
            if not state[3]:
                state, folded = list(step(tuple(state), int(ts), outcome, self.dead_at)), folded + 1
        self.state.update((*state, folded))
        self._move(None if state[3] else state[1])
        yield pd.DataFrame({"source_id": [key[0]], "kind": ["state"], "at": [folded], "interval": [state[0]], "next_poll_at": [state[1]], "fails": [state[2]], "dead": [state[3]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, state = expiredTimerInfo.getExpiryTimeInMs() // 1000, self.state.get()
        self.timer.clear()
        yield pd.DataFrame({"source_id": [key[0]], "kind": ["due"], "at": [at], "interval": [state[0]], "next_poll_at": [state[1]], "fails": [state[2]], "dead": [state[3]]})

    def close(self) -> None:
        pass


def timed(log: DataFrame, sources: DataFrame | None = None, dead_at: int = DEAD_AT, late: str | None = None) -> DataFrame:
    """A stream of polls ``(source_id, ts, seq, outcome)`` to rows ``OUTPUT``: ``due`` when the next poll of a source is to be, ``state`` after the polls of a batch.

    With ``late``, such as ``"0 seconds"``, the time is that of the polls themselves: a timer fires once a poll so much later has come, which gives the same rows for the same batches.
    Without it the time is the clock's, as for polls that happen now. ``sources(source_id, interval, next_poll_at, fails, dead)`` are the states at the
    beginning. Polls of a source in one batch are folded in order of ``ts`` and ``seq``; one that comes more than ``late`` after later ones of any source is ignored.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.select(F.col("source_id").cast("bigint").alias("source_id"), F.col("ts").cast("bigint").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "outcome", F.timestamp_seconds("ts").alias("_time"))
    if late is not None:
        rows = rows.withWatermark("_time", late)
    start = None if sources is None else sources.select(F.col("source_id").cast("bigint").alias("source_id"), "interval", "next_poll_at", "fails", "dead").groupBy("source_id")
    return rows.groupBy("source_id").transformWithStateInPandas(PollTimers(dead_at), OUTPUT, "Append", "EventTime" if late is not None else "ProcessingTime", start)


def run_timers(log: DataFrame, out: str, sources: DataFrame | None = None, dead_at: int = DEAD_AT, late: str = "0 seconds") -> tuple[DataFrame, DataFrame]:
    """Runs ``timed`` over all there is and returns the due events of this and earlier runs over ``out``, and the last state of each polled source."""
    spark = log.sparkSession
    timed(log, sources, dead_at, late).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(OUTPUT).parquet(f"{out}/rows")
    last = rows.where("kind = 'state'").groupBy("source_id").agg(F.max_by(F.struct("interval", "next_poll_at", "fails", "dead"), "at").alias("s")).select("source_id", "s.*")
    return rows.where("kind = 'due'").select("source_id", F.col("at").alias("due_at")), last
