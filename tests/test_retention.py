"""Retention by day, chains of parents, counts of the writing job, outline import, folding of letters."""

import random
import unicodedata

from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.operators.chains import parent_chains
from tidemark.operators.retention import DAY, DayStore, retain
from tidemark.plans import search
from tidemark.schema import FOLDERS, ITEMS, SOURCES, STATES, TOMBSTONES
from tidemark.sources import opml
from tidemark.sources.snapshots import Snapshots


def test_a_sweep_touches_expired_days_only(spark, tmp_path):
    r = random.Random(1)
    items = [(k, 1, f"g{k}", "u", "t", "", 0, r.randrange(10 * DAY), "", "", 0) for k in range(400)] + [(999, 1, "edge", "u", "t", "", 0, 4 * DAY + 100, "", "", 0)]
    df = spark.createDataFrame(items, ITEMS)
    states = [(k, False, k % 5 == 0, None, None, 0) for k in range(0, 400, 2)] + [(0, True, True, None, None, 0)]
    days, st, marks = DayStore(spark, f"file://{tmp_path}/i"), Snapshots(spark, f"file://{tmp_path}/s"), Snapshots(spark, f"file://{tmp_path}/t")
    days.add(df.where("id < 200"))
    days.add(df.where("id >= 200"))
    st.write(spark.createDataFrame(states, STATES))
    marks.write(spark.createDataFrame([(1, "item", 5, 10), (2, "source", 6, 50), (3, "folder", 6, 70)], TOMBSTONES))
    before = 4 * DAY + 100
    old = {(p["name"], p["day"]) for p in days.versions.current()[1] if p["day"] >= 5}
    want, want_states, _ = store.sweep(df, st.read(STATES), before, 77)
    gone = sorted(x.id for x in store.sweep_victims(df, st.read(STATES), before).collect())
    want_states = sorted(map(repr, want_states.collect()))
    assert retain(days, st, marks, 77, before, 50, (ITEMS, STATES, TOMBSTONES)) == {"swept": len(gone), "purged": 1}
    assert sorted(map(repr, days.read(ITEMS).select(df.columns).collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, st.read(STATES).collect())) == want_states
    assert sorted((x.entity_type, x.entity_id, x.deleted_at) for x in marks.read(TOMBSTONES).collect()) == sorted([("source", 6, 50), ("folder", 6, 70), *(("item", k, 77) for k in gone)])
    assert {(p["name"], p["day"]) for p in days.versions.current()[1] if p["day"] >= 5} == old and 999 not in gone
    opened = days._read([p for p in days.versions.current()[1] if p["day"] * DAY < 2 * DAY], ITEMS).inputFiles()
    assert {f.split("day=")[1][0] for f in opened} == {"0", "1"}
    assert days.sweep(spark.createDataFrame([], STATES), DAY, 78, ITEMS)[1] == sum(x.fetched_at < DAY for x in want.collect())
    assert 0 not in days.days() and days.sweep(spark.createDataFrame([], STATES), DAY, 79, ITEMS)[1] == 0


def chain_by_hand(up, k):
    n, at, last, seen = 0, up.get(k), k, {k}
    while at is not None:
        n += 1
        if at in seen:
            return None, None
        seen.add(at)
        if at in up:
            last = at
        at = up.get(at)
    return n, last


def test_chains_forests_and_cycles(spark, monkeypatch):
    r = random.Random(2)
    up = {k: (k - 1 if k % 37 else None) for k in range(1, 120)} | {200: 200, 201: 202, 202: 203, 203: 201, 204: 201, 205: 204, 300: 9999, 301: 300, 400: None}
    up |= {500 + k: (500 + r.randrange(k) if k and r.random() < 0.9 else None) for k in range(60)}
    df = spark.createDataFrame(list(up.items()), "id long, parent_id long")
    got = {x.id: (x.depth, x.root) for x in parent_chains(df).collect()}
    assert got == {k: chain_by_hand(up, k) for k in up}
    capped = {x.id: x.depth for x in store.folder_depths(df).collect()}
    assert capped == {k: min(11, 11 if d is None else d) for k, (d, _) in got.items()}
    assert parent_chains(df.limit(0)).count() == 0
    shallow = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent_id long")
    joins, kind = [], type(df)
    monkeypatch.setattr(kind, "join", lambda self, *a, f=kind.join, **b: (joins.append(1), f(self, *a, **b))[1])
    assert [x.depth for x in store.folder_depths(shallow).orderBy("id").collect()] == [0, 1, 2] and len(joins) == 2
    store.folder_depths(df)
    assert len(joins) == 6


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, "a")], "id long, source_id long, guid string")
    batch = spark.createDataFrame([(2, 1, "a"), (3, 1, "b"), (4, 1, "b"), (5, 2, "a")], "id long, source_id long, guid string")
    fresh, seen = store.upsert_items_counted(items, batch)
    fresh.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"stored": 2, "rejected": 2} and sorted(x.id for x in spark.read.parquet(f"{tmp_path}/out").collect()) == [3, 5]


def test_outlines_come_into_the_store(spark):
    sources = spark.createDataFrame([(4, "rss", "http://known", "k")], "id long, type string, url string, title string").withColumn("folder_id", F.lit(None).cast("long"))
    sources = spark.createDataFrame([], SOURCES).unionByName(sources, allowMissingColumns=True)
    folders = spark.createDataFrame([(7, "old", None, 0, 0)], FOLDERS)
    body = """<opml><body><outline text="F"><outline text="a" xmlUrl="http://a"/><outline text="k" xmlUrl="http://known"/><outline text="G"><outline xmlUrl="http://lost"/></outline></outline>
      <outline text="late" xmlUrl="http://a"/><outline title="no url" type="RSS"/><outline text="E"/></body></opml>"""
    s, f, skipped = opml.import_into(sources, folders, spark.createDataFrame([(1, body), (2, body)], "file long, body string"), 55)
    assert [(x.id, x.name, x.parent_id) for x in f.orderBy("id").collect()] == [(7, "old", None), (8, "F", None), (9, "E", None), (10, "F", None), (11, "E", None)]
    assert [(x.id, x.url, x.title, x.folder_id, x.created_at) for x in s.where("id > 4").orderBy("id").collect()] == [(5, "http://a", "late", None, 55)]  # feeds outside of folders come first
    assert sorted((x.file, x.title, x.reason) for x in skipped.collect()) == sorted(
        [(k, t, r) for k in (1, 2) for t, r in (("a", "came before"), ("k", "stored already"), ("no url", "no url"))] + [(2, "late", "came before")])
    counts = {x.file: (x.folders_created, x.sources_created, x.skipped) for x in opml.import_counts(spark.createDataFrame([(1, body)], "file long, body string"), sources).collect()}
    assert counts == {1: (2, 1, 3)}


def test_letters_of_any_script_fold_as_unicode_says(spark):
    letters = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if c.isalpha()]
    got = {x.c: x.t for x in spark.createDataFrame([(c,) for c in letters], "c string").select("c", search.tokens(F.col("c")).alias("t")).collect()}
    for c in letters:
        low = c.lower()
        base = "".join(x for x in unicodedata.normalize("NFD", low) if not 0x300 <= ord(x) < 0x370) if unicodedata.normalize("NFD", low)[0].isalpha() else low
        if unicodedata.normalize("NFD", low) == unicodedata.normalize("NFKD", low):
            assert got[c] == [base], (c, got[c], base)
    assert [x.t for x in spark.createDataFrame([("élève ЁЛКА Άλφα",)], "c string").select(search.tokens(F.col("c")).alias("t")).collect()] == [["eleve", "елка", "αλφα"]]
