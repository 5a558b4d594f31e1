"""Polls written back, records as JSON, folder writes, and streams of many batches."""

import json

from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.plans import poll
from tidemark.schema import FOLDERS, SOURCES
from tidemark.sources import feeds, records
from tidemark.streaming.jobs import last_states, upsert_stream

POLLS = "source_id bigint, seq bigint, ts bigint, outcome string, etag string, last_modified string"


def sources(spark, *rows):
    base = {"type": "rss", "next_poll_at": 5, "etag": "old", "last_modified": "then", "consec_fails": 0, "is_dead": False, "poll_interval": 3600, "updated_at": 1}
    return spark.createDataFrame([], SOURCES).unionByName(spark.read.schema(SOURCES).json(spark.sparkContext.parallelize([json.dumps(base | r) for r in rows])))


def test_polls_are_written_back(spark):
    s = sources(spark, {"id": 1}, {"id": 2}, {"id": 3}, {"id": 4, "is_dead": True}, {"id": 5, "consec_fails": 9}, {"id": 6}, {"id": 7, "etag": None})
    log = [
        (1, 1, 100, "new", "a", None), (2, 1, 100, "unchanged", "b", "b"), (3, 1, 100, "failed", "c", "c"), (4, 1, 100, "new", "d", "d"), (5, 1, 100, "failed", None, None), (5, 2, 200, "new", "e", "e"),
        (6, 2, 200, "none", "late", "late"), (6, 1, 100, "gone", None, None), (9, 1, 100, "new", "x", "x"),
    ]
    got = {r.id: (r.poll_interval, r.next_poll_at, r.consec_fails, r.is_dead, r.last_poll_at, r.etag, r.last_modified, r.updated_at) for r in poll.apply_polls(s, spark.createDataFrame(log, POLLS), 999).collect()}
    assert got == {
        1: (1800, 1900, 0, False, 100, "a", "", 999), 2: (5400, 5500, 0, False, 100, "old", "then", 999), 3: (3600, 160, 1, False, 100, "", "", 999),
        4: (3600, 5, 0, True, None, "old", "then", 1), 5: (3600, 100 + 60 * 2**9, 10, True, 100, "", "", 999), 6: (3600, 100 + 86400, 1, True, 100, "", "", 999), 7: (3600, 5, 0, False, None, None, "then", 1),
    }


def test_first_polls_are_spread(spark):
    df = spark.range(400).select(poll.first_poll(F.concat(F.lit("u"), "id"), F.lit(3600), 1000).alias("t"))
    got = [r.t for r in df.collect()]
    assert min(got) >= 1000 and max(got) <= 4600 and len(set(got)) > 300


def test_bodies_to_records_and_back(spark):
    rows = [(1, '{"name": "a", "parent_id": 4, "more": 1}'), (2, "{"), (3, None), (4, ""), (5, "[1]"), (6, '{"name": 5}'), (7, '{"id": "x"}'), (8, "{}")]
    good, bad = records.parsed(spark.createDataFrame(rows, "n long, body string"), "folders")
    assert [(r.n, r.name, r.parent_id) for r in good.orderBy("n").collect()] == [(1, "a", 4), (8, None, None)]
    assert sorted(r.n for r in bad.collect()) == [2, 3, 4, 5, 6, 7]
    got = [json.loads(r.value) for r in records.lines(sources(spark, {"id": 1, "url": "u", "folder_id": 2}, {"id": 2, "url": "v"})).collect()]
    assert "etag" not in got[0] and got[0]["folder_id"] == 2 and "folder_id" not in got[1]


def test_folders_are_inserted_and_moved(spark):
    f = spark.createDataFrame([(1, "a", None, 0, 0), (2, "b", 1, 0, 0), (3, "c", 2, 0, 0)], FOLDERS)
    new = spark.createDataFrame([(5, "under b", 2), (6, "under c", 3), (7, "", None), (4, "top", None)], "seq long, name string, parent_id long")
    all_, rejected = store.insert_folders(f, new, 77)
    assert [(r.id, r.name, r.parent_id, r.created_at) for r in all_.where("id > 3").orderBy("id").collect()] == [(4, "top", None, 77), (5, "under b", 2, 77)]
    assert {(r.seq, r.reason) for r in rejected.collect()} == {(6, "too deep"), (7, "name is required")}
    changes = spark.createDataFrame([(2, "", None), (1, "new", None), (3, None, 3), (9, "x", None)], "id long, name string, parent_id long")
    moved, deep = store.update_folders(f, changes, 88)
    assert [(r.id, r.name, r.parent_id, r.updated_at) for r in moved.orderBy("id").collect()] == [(1, "new", None, 88), (2, "b", 1, 88), (3, "c", 2, 0)]
    assert [r.id for r in deep.collect()] == [3]


def test_malformed_feeds_of_both_kinds(spark):
    rows = [
        (1, "<rss><channel><item><guid>g</guid></item></channel></rss>"), (2, "<rss><channel>"), (3, '<feed xmlns="x"><entry><id>i</id></entry></feed>'), (4, "<feed><entry>"), (5, "no markup"), (6, None), (7, ""),
    ]
    assert sorted(r.source_id for r in feeds.malformed(spark.createDataFrame(rows, "source_id long, body string")).collect()) == [2, 4, 5, 6, 7]


def test_streams_of_many_batches_go_on_where_they_ended(spark, tmp_path):
    there, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows, schema, k: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{there}{k}")
    items, polls = "id long, source_id long, guid string, url string", "source_id long, ts long, event_id long, outcome string"
    read = lambda schema, k: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{there}{k}")
    put([(1, 1, "a", "u1"), (2, 1, "b", "u2"), (3, 1, "a", "u3")], items, 1)
    put([(4, 1, "a", "u4"), (5, 2, "a", "u5")], items, 1)
    first = {(r.source_id, r.guid): r.url for r in upsert_stream(read(items, 1), f"{out}1").collect()}
    assert set(first) == {(1, "a"), (1, "b"), (2, "a")} and first[1, "b"] == "u2"
    put([(6, 2, "a", "u6"), (7, 3, "c", "u7"), (8, 1, "b", "u8")], items, 1)
    again = upsert_stream(read(items, 1), f"{out}1").collect()
    assert {(r.source_id, r.guid): r.url for r in again} == first | {(3, "c"): "u7"} and len(again) == 4
    log = [(s, 100 * k + s, k, o) for s in (1, 2) for k, o in enumerate(("failed", "new", "none", "failed", "failed"))]
    for k in range(5):
        put([x for x in log if x[2] == k], polls, 2)
        got = {r.source_id: (r.interval, r.next_poll_at, r.fails, r.dead) for r in last_states(read(polls, 2), f"{out}2").collect()}
    for s in (1, 2):
        state = (3600, 0, 0, False)
        for _, ts, _, o in (x for x in log if x[0] == s):
            state = poll.step(state, ts, o)
        assert got[s] == state
