"""The poll state of sources: due sources, intervals, backoff, and the fold of poll outcomes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Seconds between polls at least and at most, the first backoff, the longest, and the failures that end a source.
SHORTEST, LONGEST, BACKOFF, LONGEST_BACKOFF, DEAD_AT = 900, 21600, 60, 86400, 10


def due(sources: DataFrame, now: int) -> DataFrame:
    """Living sources of which the next poll is now or before, in its order."""
    return sources.where((F.col("next_poll_at") <= now) & ~F.col("is_dead")).orderBy("next_poll_at", "id")


def next_interval(interval: Column, had_new: Column) -> Column:
    """Half after new items, down to the shortest; else half as long again, up to the longest."""
    return F.when(had_new, F.greatest(F.floor(interval / 2), F.lit(SHORTEST))).otherwise(F.least(F.floor(interval * 3 / 2), F.lit(LONGEST))).cast("bigint")


def backoff(fails: Column) -> Column:
    """A minute, doubled by each failure after the first, a day at most."""
    return F.least(F.lit(BACKOFF) * F.pow(F.lit(2), F.least(F.greatest(fails - 1, F.lit(0)), F.lit(40))), F.lit(LONGEST_BACKOFF)).cast("bigint")


def first_poll(url: Column, interval: Column, now: int) -> Column:
    """Now and a part of the interval that the url's hash decides."""
    return F.lit(now) + F.pmod(F.xxhash64(url), interval + 1)


def routed(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources by type: rss, html, and those of neither, which are skipped."""
    return sources.where("type = 'rss'"), sources.where("type = 'html'"), sources.where("type not in ('rss', 'html') or type is null")


def outcome(kind: Column, status: Column, new_items: Column, parsed: Column) -> Column:
    """A poll's outcome. Feeds: new or none, unchanged (304), gone (404, 410), failed; pages know no unchanged or gone."""
    ok = (status == 200) & F.coalesce(parsed, F.lit(False))
    feed = kind == "rss"
    return (
        F.when(ok, F.when(new_items > 0, "new").otherwise("none")).when(feed & (status == 304), "unchanged")
        .when(feed & status.isin(404, 410), "gone").otherwise("failed")
    )


def step(state: tuple, ts: int | None, outcome: str | None, dead_at: int = DEAD_AT) -> tuple:
    """The state ``(interval, next_poll_at, fails, dead)`` after an outcome. Dead sources stay as they are."""
    interval, _, fails, dead = state
    if dead:
        return state
    if outcome in ("gone", "failed"):
        wait = LONGEST_BACKOFF if outcome == "gone" else min(BACKOFF * 2 ** min(fails, 40), LONGEST_BACKOFF)
        return interval, None if ts is None else ts + wait, fails + 1, outcome == "gone" or fails + 1 >= dead_at
    if outcome == "new":
        interval = max(interval // 2, SHORTEST)
    elif outcome in ("none", "unchanged"):
        interval = min(interval * 3 // 2, LONGEST)
    return interval, None if ts is None else ts + interval, 0, None if outcome is None else False


START = "named_struct('interval', cast(3600 as bigint), 'next_poll_at', cast(0 as bigint), 'fails', cast(0 as bigint), 'dead', false)"


def _folded(dead_at: int, kind: pa.DataType):
    """Rows sorted by source and order to the last state of each source; one source's state is held at a time."""

    def run(batches):
        now, state, any_ = None, None, False
        for batch in batches:
            done = []
            for source, ts, outcome, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not any_ or source != now:
                    if any_:
                        done.append((now, *state))
                    now, state, any_ = source, (start["interval"], start["next_poll_at"], start["fails"], start["dead"]), True
                state = step(state, ts, outcome, dead_at)
            yield _states(done, kind)
        if any_:
            yield _states([(now, *state)], kind)

    return run


def _states(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["source_id", "interval", "next_poll_at", "fails", "dead"]
    )


def fold_polls(log: DataFrame, start: str = START, dead_at: int = DEAD_AT) -> DataFrame:
    """Outcomes ``(source_id, seq, ts, outcome)`` folded in order of ``seq``: the final state of each source.

    ``start`` is SQL over the log's columns, alike for all rows of a source. A source's rows are
    sorted within their partition, on disk if need be, and pass one by one through its state: no
    row or task holds all outcomes of a source.
    """
    rows = log.select("source_id", "seq", "ts", "outcome", F.expr(start).alias("start")).repartition("source_id").sortWithinPartitions("source_id", "seq", "ts", "outcome")
    source = log.schema["source_id"].dataType
    return rows.select("source_id", F.col("ts").cast("bigint").alias("ts"), "outcome", "start").mapInArrow(
        _folded(dead_at, to_arrow_type(source)), f"source_id {source.simpleString()}, interval bigint, next_poll_at bigint, fails bigint, dead boolean"
    )


_POLLED = "id bigint, interval bigint, next_poll_at bigint, fails bigint, dead boolean, last_poll_at bigint, etag string, last_modified string, polled boolean"


def _applied(dead_at: int):
    """Rows sorted by source and order to the poll state of each source after all of them."""

    def run(batches):
        now, held = None, None
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _POLLED.split(", ")])

        for batch in batches:
            done = []
            for source, ts, result, etag, modified, start in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held is None or source != now:
                    if held is not None:
                        done.append((now, *held))
                    now, held = source, (start["interval"], start["next_poll_at"], start["fails"], start["dead"], start["last_poll_at"], start["etag"], start["last_modified"], False)
                if not held[3]:  # a dead source is not polled
                    if start["page"] or result not in ("new", "none", "unchanged"):
                        etag = modified = None
                    elif result == "unchanged":
                        etag, modified = held[5], held[6]
                    held = (*step(held[:4], ts, result, dead_at), ts, etag or "", modified or "", True)
            yield batch_of(done)
        if held is not None:
            yield batch_of([(now, *held)])

    return run


def apply_polls(sources: DataFrame, polls: DataFrame, now: int, dead_at: int = DEAD_AT) -> DataFrame:
    """``sources`` after ``polls(source_id, seq, ts, outcome, etag, last_modified)``, in order of ``seq`` for each source.

    A poll sets its time, the next poll, the interval, failures and death (``step``), and ``updated_at`` to ``now``. The
    validators are those of a good answer (none where it has none), stay after an unchanged one, and are cleared by failures; html sources have none after
    any poll. Sources that are dead are not polled, nor are html sources without a scraper config, and polls of unknown sources are ignored. A source's polls pass one by one through its state, sorted within their partition.
    """
    start = F.struct(
        F.col("poll_interval").cast("bigint").alias("interval"), F.col("next_poll_at").cast("bigint").alias("next_poll_at"), F.col("consec_fails").cast("bigint").alias("fails"), F.col("is_dead").alias("dead"),
        F.col("last_poll_at").cast("bigint").alias("last_poll_at"), F.coalesce("etag", F.lit("")).alias("etag"), F.coalesce("last_modified", F.lit("")).alias("last_modified"),
        F.coalesce(F.col("type") == "html", F.lit(False)).alias("page") if "type" in sources.columns else F.lit(False).alias("page"),
    )
    polled = sources.where("not (type <=> 'html') or scraper_config is not null") if {"type", "scraper_config"} <= set(sources.columns) else sources
    rows = polls.withColumnsRenamed({"etag": "_etag", "last_modified": "_modified"}).join(polled.select(F.col("id").alias("source_id"), start.alias("start")), "source_id")
    rows = rows.repartition("source_id").sortWithinPartitions("source_id", "seq", "ts", "outcome")
    after = rows.select(F.col("source_id").cast("bigint"), F.col("ts").cast("bigint"), "outcome", "_etag", "_modified", "start").mapInArrow(_applied(dead_at), _POLLED).where("polled").drop("polled")
    new = {"poll_interval": "interval", "next_poll_at": "next_poll_at", "consec_fails": "fails", "is_dead": "dead", "last_poll_at": "last_poll_at", "etag": "etag", "last_modified": "last_modified"}
    joined = sources.join(after.select(F.col("id").alias("_id"), *(F.col(v).alias(f"_{k}") for k, v in new.items())), F.col("id") == F.col("_id"), "left")
    polled = F.col("_id").isNotNull()
    return joined.select(
        *(F.when(polled, F.col(f"_{c}")).otherwise(F.col(c)).cast(sources.schema[c].dataType).alias(c) if c in new else F.when(polled, F.lit(now)).otherwise(F.col(c)).cast("bigint").alias(c) if c == "updated_at" else F.col(c) for c in sources.columns)
    )
