"""Streams: timers of due sources, and first-wins keys in sorted runs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.plans import poll
from tidemark.streaming import key_runs
from tidemark.streaming.key_runs import bloom, may_hold, upsert_by_runs
from tidemark.streaming.timers import run_timers

ITEMS = "id long, source_id long, guid string, url string"


def test_timers_over_many_batches(spark, tmp_path):
    r, log, t = random.Random(1), [], 1_000_000
    for k in range(90):
        t += r.randrange(1, 4000)
        log.append((r.randrange(6), t, k, r.choice(["new", "none", "failed", "failed", "failed", "unchanged"])))
    schema, start = "source_id long, ts long, seq long, outcome string", [(0, 900, 1_000_500, 1, False), (5, 900, 1, 3, True), (77, 3600, 1_000_100, 0, False)]
    sources = spark.createDataFrame(start, "source_id long, interval long, next_poll_at long, fails long, dead boolean")
    held = {s: tuple(x) for s, *x in start}
    want, timers, mark = [], {s: x[1] for s, *x in start if not x[3]}, 0
    for b in range(3):
        rows = log[30 * b : 30 * b + 30]
        spark.createDataFrame(r.sample(rows, 30), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        due, last = run_timers(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", sources, dead_at=4)
        for s, ts, _, o in rows:
            held[s] = poll.step(held.get(s, (3600, 0, 0, False)), ts, o, 4)
        for s in {x[0] for x in rows}:
            timers.pop(s, None)
            if not held[s][3]:
                timers[s] = held[s][1]
        mark = rows[-1][1]
        for s in [s for s, at in timers.items() if at < mark]:
            want.append((s, timers.pop(s)))
        got = sorted((x.source_id, x.due_at) for x in due.collect())
        assert got == sorted(want)
    assert {x.source_id: (x.interval, x.next_poll_at, x.fails, x.dead) for x in last.collect()} == {s: held[s] for s in {x[0] for x in log}}
    assert any(x[3] for x in held.values()) and len(want) > 3


def test_filters_miss_nothing():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        h = r.integers(-(2**63), 2**63 - 1, n)
        made = bloom(h)
        assert may_hold(h, made).all() and may_hold(r.integers(-(2**63), 2**63 - 1, 2000), made).mean() < 0.02


def test_small_batches_read_little_and_equal_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_runs, "SLICE", 16)
    r = random.Random(3)
    batches = [[(100 * b + k, k % 3, f"g{b}-{k}" if k % 4 else f"old{r.randrange(3 * b + 1)}", f"u{b}-{k}") for k in range(24)] for b in range(9)]
    for b in batches:
        spark.createDataFrame(b, ITEMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got, reads = upsert_by_runs(stream(), f"file://{tmp_path}/out", fan=3)
    keys = [(x.source_id, x.guid) for x in got.collect()]
    assert len(keys) == len(set(keys)) == len({(s, g) for b in batches for _, s, g, _ in b})
    first = {}
    for b in batches:  # files are taken in the order they were written
        for i, s, g, u in b:
            first.setdefault((s, g), (i, u))
    assert {(x.source_id, x.guid): (x.id, x.url) for x in got.collect()} == first
    assert len(reads) == 9 and max(n for n, _, _ in reads) <= 5  # 2 runs a level at most after a merge
    spark.createDataFrame([(9000 + k, 8, f"new{k}", "u") for k in range(30)], ITEMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, reads = upsert_by_runs(stream(), f"file://{tmp_path}/out", fan=3)
    assert got.count() == len(keys) + 30 and len(reads) == 1 and reads[0][2] <= 32  # a filter errs now and then, by a slice


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    runs = key_runs.KeyRuns(spark, f"file://{tmp_path}/keys")
    a, b = (spark.createDataFrame([(k, 1, f"g{k % 7}", f"u{k}") for k in range(n)], ITEMS) for n in (5, 20))
    runs.add(a, 0, f"file://{tmp_path}/items")
    runs.add(a, 0, f"file://{tmp_path}/items")
    runs.add(b, 1, f"file://{tmp_path}/items")
    runs.add(b.limit(0), 2, f"file://{tmp_path}/items")
    got = spark.read.parquet(f"{tmp_path}/items")
    assert sorted((x.guid, x.url, x.batch) for x in got.collect()) == [(f"g{k}", f"u{k}", 0 if k < 5 else 1) for k in range(7)]
    assert [p["n"] for p in runs.versions.current()[1] if p["level"] >= 0] == [5, 2]
    assert got.where(F.col("h").isNull()).count() == 0
