"""Answers, changes and ordered text as data sources; rounds of polls; records as clients get them."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.plans import poll
from tidemark.plans.rounds import page_round
from tidemark.schema import FOLDERS, ITEMS, SOURCES, STATES, TOMBSTONES
from tidemark.sources import opml, records
from tidemark.sources.answers import SCHEMA, AnswersReader, body_text, read_answers, write_answers
from tidemark.sources.changes import cursor_of, read_changes, stream_changes
from tidemark.sources.files import Folder
from tidemark.sources.snapshots import Snapshots
from tidemark.sources.text_files import read_text, write_text
from tidemark.streaming.jobs import collect_changes


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if "_commits" not in d and not f.startswith("."))


def test_answers_come_back_by_source_and_to_the_byte(spark, tmp_path):
    r = random.Random(1)
    rows = [(k % 9 if k % 10 else None, f"u{k}", None, 200, "e\n" if k % 2 else None, None, k, None, None if k % 7 == 0 else bytes(r.randrange(256) for _ in range(k % 50))) for k in range(200)]
    rows += [(5, "é", "f", 500, "", "", None, "time\nout", "é".encode() * 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    write_answers(df, str(tmp_path))
    key = lambda x: tuple(map(repr, x))
    back = lambda got: sorted(((*x[:-1], None if x[-1] is None else bytes(x[-1])) for x in got.collect()), key=key)
    assert back(read_answers(spark, str(tmp_path))) == sorted(rows, key=key)
    assert back(read_answers(spark, f"file://{tmp_path}").where("source_id in (3, 5) and status = 200")) == sorted((x for x in rows if x[0] in (3, 5) and x[3] == 200), key=key)
    cut = [(*x[:-1], None if x[-1] is None else x[-1][:21]) for x in rows]
    assert back(read_answers(spark, str(tmp_path), limit=21)) == sorted(cut, key=key)
    whole = read_answers(spark, str(tmp_path), limit=21).where("url = 'é'").select(body_text(F.col("body")).alias("t")).first().t
    assert whole == "é" * 10 + "�"
    assert read_answers(spark, str(tmp_path)).where("fetched_at >= 190").count() == 10 and read_answers(spark, str(tmp_path)).count() == 201
    write_answers(df.limit(2), str(tmp_path))
    assert read_answers(spark, str(tmp_path)).count() == 203
    write_answers(df.limit(3), str(tmp_path), mode="overwrite")
    assert read_answers(spark, str(tmp_path)).count() == 3
    write_answers(df.limit(0), f"{tmp_path}/empty")
    assert read_answers(spark, f"{tmp_path}/empty").count() == 0


def test_a_source_opens_its_files_only(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    df = spark.range(400).selectExpr("id % 40 as source_id", "concat('u', id) as url", "cast(null as string) as final_url", "200 as status", "'' as etag", "'' as last_modified", "id as fetched_at", "cast(null as string) as error", "cast('b' as binary) as body")
    write_answers(df, str(tmp_path))
    every = AnswersReader(str(tmp_path), ["url"], 10)
    one = AnswersReader(str(tmp_path), ["url"], 10)
    assert list(one.pushFilters([EqualTo(("source_id",), 7)])) == []
    late = AnswersReader(str(tmp_path), ["url"], 10)
    assert len(list(late.pushFilters([GreaterThan(("fetched_at",), 1000)]))) == 1
    files = lambda reader: [f for p in reader.partitions() for f in p.value]
    assert 0 < len(files(one)) <= len(files(every)) / 4 and files(late) == []
    assert sorted(x for p in one.partitions() for x in one.read(p)) == sorted((f"u{k}",) for k in range(7, 400, 40))


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    bad = F.when(F.col("id") == 97, F.raise_error(F.lit("no good"))).otherwise(F.lit("x"))
    with pytest.raises(Exception, match="no good"):
        write_text(spark.range(100).repartition(4).select(bad.alias("line")), f"{tmp_path}/t", "head")
    answers = spark.range(100).select(F.col("id").alias("source_id"), bad.alias("url"), F.lit("").alias("final_url"), F.lit(1).alias("status"), F.lit("").alias("etag"), F.lit("").alias("last_modified"), F.col("id").alias("fetched_at"), F.lit("").alias("error"), F.lit(b"").alias("body"))
    with pytest.raises(Exception, match="no good"):
        write_answers(answers, f"{tmp_path}/a")
    for name in ("t", "a"):  # tasks that were killed with the others may have been at work still
        for _ in range(20):
            Folder(f"{tmp_path}/{name}").clean(-1)
            time.sleep(0.05)
    assert files_of(tmp_path) == [] and read_text(spark, f"{tmp_path}/t").count() == 0 and read_answers(spark, f"{tmp_path}/a").count() == 0


def test_lines_keep_their_order(spark, tmp_path):
    want = [f"line {k} é" for k in range(1000)]
    df = spark.range(1000).repartition(7).orderBy("id").select(F.concat(F.lit("line "), "id", F.lit(" é")))
    write_text(df, str(tmp_path), "<a>", "</a>")
    assert [x.value for x in read_text(spark, str(tmp_path)).orderBy("place").collect()] == ["<a>", *want, "</a>"]
    write_text(df.limit(1), str(tmp_path))
    assert [x.value for x in read_text(spark, str(tmp_path)).collect()] == want[:1]
    write_text(df.limit(1), str(tmp_path), mode="append")
    assert read_text(spark, str(tmp_path)).count() == 2


def test_an_outline_file_is_written_without_gathering_it(spark, tmp_path):
    folders = spark.createDataFrame([(1, "B & b"), (2, "A"), (3, "empty"), (4, "A")], "id long, name string")
    sources = spark.createDataFrame([(k, f"t{k:02d}", f"http://u/{k}?a&b", "rss" if k % 2 else "html", [None, 1, 2, 4, 9][k % 5]) for k in range(20)], "id long, title string, url string, type string, folder_id long")
    opml.write_document(sources, folders, str(tmp_path), "Feeds & more")
    whole = "".join(x.value for x in read_text(spark, str(tmp_path)).orderBy("place").collect())
    lines = opml.export(sources, folders)
    boxes = [x.line for x in lines.where("section = 1").collect()]
    assert all(b in whole for b in boxes) and len(boxes) == 3 and whole.index('"A"') < whole.index("B &amp; b") and "empty" not in whole
    assert whole.count("<outline") == 23 and whole.startswith('<?xml version="1.0" encoding="UTF-8"?><opml version="2.0"><head><title>Feeds &amp; more</title>') and whole.endswith("</body></opml>")
    back, feeds = opml.imported(spark.createDataFrame([(1, whole)], "file long, body string"))
    assert sorted(x.name for x in back.collect()) == ["A", "A", "B & b"] and sorted(x.url for x in feeds.collect()) == sorted(f"http://u/{k}?a&b" for k in range(20))


def test_lines_of_rows_with_nulls(spark):
    f = spark.createDataFrame([(1, None, None, 3, 4), (2, 'n"\n', 5, None, 4)], FOLDERS)
    assert [x.value for x in records.lines(f).collect()] == ['{"id":1,"name":null,"created_at":3,"updated_at":4}', '{"id":2,"name":"n\\"\\n","parent_id":5,"created_at":null,"updated_at":4}']
    assert [x.value for x in records.lines(f.select("id", "name")).collect()][0] == '{"id":1,"name":null}'
    assert spark.range(1).select(records.error_line(F.lit('a "b"')).alias("e")).first().e == '{"error":"a \\"b\\""}'


def store_at(spark, path):
    return {k: Snapshots(spark, f"{path}/{k}") for k in ("items", "states", "folders", "sources", "tombstones")}


def test_changes_in_one_read_and_as_a_stream(spark, tmp_path):
    tables, path, out = store_at(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/s", f"file://{tmp_path}/out"
    item = lambda k, at: (k, 1, f"g{k}", f"u{k}", "t", "", 0, at, "<p>", "hidden", at)
    items = [item(k, 100 + k // 3) for k in range(60)]
    tables["items"].write(spark.createDataFrame(items, ITEMS).repartition(4))
    tables["states"].write(spark.createDataFrame([(1, True, False, 5, None, 110), (2, False, False, None, None, 90)], STATES))
    tables["folders"].write(spark.createDataFrame([(1, "f", None, 1, 105)], FOLDERS))
    tables["sources"].write(spark.createDataFrame([], SOURCES))
    key = lambda df: sorted((x.kind, x.id, x.changed_at) for x in df.collect())
    want = [("items", x[0], x[7]) for x in items if x[7] > 104] + [("states", 1, 110), ("folders", 1, 105)]
    got = read_changes(spark, path, 104)
    assert key(got) == sorted(want)
    lines = {(x.kind, x.id): json.loads(x.line) for x in got.collect()}
    assert "content_text" not in lines["items", 50] and lines["items", 50]["content_html"] == "<p>" and "starred_at" not in lines["states", 1] and lines["states", 1]["read_at"] == 5
    for bad in ("soon", " 1", "1.5", "9223372036854775808", "١"):
        with pytest.raises(ValueError, match="since must be"):
            read_changes(spark, path, bad)
    assert key(read_changes(spark, path, "")) == key(read_changes(spark, path, "+0")) == key(read_changes(spark, path)) and cursor_of("-5") == -5
    assert key(read_changes(spark, path, 10**9)) == []
    first = collect_changes(stream_changes(spark, path, 104), out)
    assert key(first) == sorted(want)
    tables["items"].write(spark.createDataFrame([*items[3:], item(99, 140)], ITEMS))
    tables["tombstones"].write(spark.createDataFrame([(1, "item", 0, 150), (2, "item", 1, 151), (3, "source", 7, 90)], TOMBSTONES))
    tables["states"].write(spark.createDataFrame([(1, False, False, None, None, 145), (2, False, False, None, None, 90)], STATES))
    again = collect_changes(stream_changes(spark, path, 104), out)
    assert key(again) == sorted([*want, ("items", 99, 140), ("tombstones", 0, 150), ("tombstones", 1, 151), ("states", 1, 145)])
    assert key(collect_changes(stream_changes(spark, path, 104), out)) == key(again)


def test_pages_are_polled_end_to_end(spark):
    config = {"index_selector": "#in", "date_selector": "", "content_selector": ""}
    base = {"type": "html", "next_poll_at": 5, "etag": "old", "last_modified": "then", "consec_fails": 1, "is_dead": False, "poll_interval": 3600, "updated_at": 1, "scraper_config": config}
    rows = [{"id": 1, "url": "http://h/i"}, {"id": 2, "url": "http://h2/i"}, {"id": 3, "url": "http://h3/i", "scraper_config": None}, {"id": 4, "url": "http://h4/i", "type": "rss"}, {"id": 5, "url": "http://h5/i", "is_dead": True}]
    sources = spark.read.schema(SOURCES).json(spark.sparkContext.parallelize([json.dumps(base | r) for r in rows]))
    page = '<a href="/out">o</a><div id="in"><a href="/a?utm_source=x">1</a><a href="/a">2</a><a href="/b#top">3</a><a href="http://z/c">4</a><a href="/known">5</a><a href="/gone">6</a></div>'
    article = "<title> T </title><article>x &amp; y</article>"
    got = [(s, u, None, st, "n", "n", 7, None, None if b is None else b.encode()) for s, u, st, b in (
        (1, "http://h/i", 200, page), (1, "http://h/a", 200, article), (1, "http://h/b", 200, article), (1, "http://h/known", 200, article), (1, "http://h/gone", 404, article), (1, "http://h/out", 200, article),
        (2, "http://h2/i", 304, None), (3, "http://h3/i", 200, page), (4, "http://h4/i", 200, page), (5, "http://h5/i", 200, page))]
    stored = spark.createDataFrame([(1, "http://h/known", "k")], "source_id long, url string, guid string")
    fresh, polls = page_round(sources, stored, spark.createDataFrame(got, SCHEMA), 100)
    assert sorted((x.source_id, x.url, x.title, x.content_text) for x in fresh.collect()) == [(1, "http://h/a", "T", "x & y"), (1, "http://h/b", "T", "x & y")]
    assert sorted((x.source_id, x.outcome, x.new_items) for x in polls.collect()) == [(1, "new", 2), (2, "failed", 0)]
    after = {x.id: (x.poll_interval, x.next_poll_at, x.consec_fails, x.etag, x.last_modified, x.updated_at) for x in poll.apply_polls(sources, polls, 99).collect()}
    assert after == {1: (1800, 1900, 0, "", "", 99), 2: (3600, 220, 2, "", "", 99), **{k: (3600, 5, 1, "old", "then", 1) for k in (3, 4, 5)}}
    forced = spark.createDataFrame([(3, 1, 100, "new", "x", "x")], "source_id long, seq long, ts long, outcome string, etag string, last_modified string")
    assert poll.apply_polls(sources, forced, 99).where("id = 3").first().updated_at == 1


def test_answers_are_read_in_batches_by_bytes(spark, tmp_path):
    from pyspark.sql.datasource import InputPartition

    from tidemark.sources.answers import Answers
    from tidemark.tables import BATCH_BYTES

    body = random.Random(3).randbytes(100_000)
    rows = [(k, f"u{k}", None, 200, None, None, k, None, None if k % 5 == 0 else body) for k in range(150)]
    write_answers(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    reader = Answers({"path": str(tmp_path)}).reader(spark.createDataFrame([], SCHEMA).schema)
    batches = [b for p in reader.partitions() for b in reader.read(InputPartition(p.value))]
    assert sum(b.num_rows for b in batches) == 150 and max(b.nbytes for b in batches) < BATCH_BYTES + 200_000
    assert read_answers(spark, str(tmp_path)).where("length(body) = 100000").count() == 120
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES
