"""The stored index against postings made anew, and versions under writers that fail or meet."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans import search, stored_index
from tidemark.plans.stored_index import StoredIndex
from tidemark.sources.snapshots import ConcurrentWrite, Snapshots

ITEMS = "id long, title string, author string, content_text string"


def equal(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def check(index, live):
    want = search.postings(live)
    counts, lengths = search.index(want)
    assert equal(index.counts(), counts.select("item_id", "term", "tf"))
    assert equal(index.postings(), want.select("item_id", "column", "place", "term"))
    assert equal(index.items(), lengths.select("item_id", F.col("len").cast("int")))
    assert equal(index.postings(prefix="a"), want.where("term like 'a%'").select("item_id", "column", "place", "term"))
    for terms in (["nowhere"], ["a1", "a1", "", "é9", "nowhere", "b5"]):
        exp = search.top(search.bm25(counts, lengths, [t for t in dict.fromkeys(terms) if t]), 5).collect()
        got = index.top(terms, 5).collect()
        assert [(r.item_id, round(r.score, 9)) for r in got] == [(r.item_id, round(r.score, 9)) for r in exp]


def test_batches_deletes_and_merges_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "SLICE", 200)
    r = random.Random(1)
    word = lambda: r.choice("abcé") + str(r.randrange(12))
    text = lambda n: None if r.random() < 0.05 else " ".join(word() for _ in range(r.randrange(n)))
    rows = [(k if k % 50 else k + (5 << 20), text(4), text(2), text(40)) for k in range(1, 150)]
    df = spark.createDataFrame(rows, ITEMS).withColumns({"term": F.lit("clash"), "off": F.lit(1)}).cache()
    index = StoredIndex(spark, f"file://{tmp_path}/index", shards=4)
    assert index.counts().count() == 0 and index.top(["a1"]).count() == 0
    index.insert(df.where("id % 2 = 0").union(df.limit(1).withColumn("id", F.lit(None).cast("long"))))
    index.insert(df.where("id % 2 = 1 or id < 20"))
    assert equal(index.postings(), search.postings(df).select("item_id", "column", "place", "term"))
    index.delete(df.where("id % 5 = 0").union(df.limit(1).withColumn("id", F.lit(99_999).cast("long"))))
    index.delete(df.where("id % 5 = 0"))
    assert equal(index.counts(), search.index(search.postings(df.where("id % 5 <> 0")))[0].select("item_id", "term", "tf"))
    index.insert(df.where("id % 10 = 0"))
    live = df.where("id % 5 <> 0 or id % 10 = 0")
    check(index, live)
    index.optimize()
    assert [p["kind"] for p in index.versions.current()[1]] == ["segment"]
    check(index, live)
    index.delete(df)
    assert index.items().count() == 0 and index.top(["a1"]).count() == 0
    index.optimize()
    assert index.items().count() == 0
    assert len(index.versions.clean(older_than=0)) >= 5 and index.items().count() == 0


def test_a_term_reads_its_shard_only(spark, tmp_path):
    rows = [(k, f"w{k}", "", f"x{k % 7} y{k}") for k in range(200)]
    index = StoredIndex(spark, f"file://{tmp_path}/index", shards=8)
    index.insert(spark.createDataFrame(rows, ITEMS))
    plan = index._read(["y17"])._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*shard#\d+", plan) and re.search(r"PushedFilters: \[.*term.*y17", plan)
    heads = index._read(["y17"]).select("n")._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "off" not in re.search(r"ReadSchema: (.*)", heads)[1]
    assert [(r.item_id, r.column, r.place) for r in index.postings(["y17"]).collect()] == [(17, "content_text", 1)]


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, "", "", " ".join(["hot"] * (9 if k // 128 == 20 else 1) + ["mid"] * (5 if 2000 <= k < 2100 else k % 3 == 0 and k < 9000) + [f"f{r.randrange(99)}" for _ in range(20)])) for k in range(20_000)]
    df = spark.createDataFrame(rows, ITEMS)
    index = StoredIndex(spark, f"file://{tmp_path}/index", ("content_text",))
    index.insert(df)
    every, needed, _, _ = index.needed(["hot", "mid"], 10)
    assert every.count() > 150 and 0 < needed.count() < 25
    want = search.top(search.bm25(*search.index(search.postings(df, ("content_text",))), ["hot", "mid"]), 10).collect()
    assert [(x.item_id, round(x.score, 9)) for x in index.top(["hot", "mid"], 10).collect()] == [(x.item_id, round(x.score, 9)) for x in want]


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    s.write(spark.range(3))
    with pytest.raises(Exception, match="no good"):
        s.write(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no good"))).otherwise(F.lit(1)).alias("id")))
    assert s.version() == 1 and s.read("id bigint").count() == 3
    s.write(spark.range(5))
    assert s.version() == 2 and s.read("id bigint").count() == 5
    (tmp_path / "t/_versions/000000000003.json").write_text("")  # a driver was lost between the file's creation and its content
    assert s.version() == 2
    s.write(spark.range(6))
    assert s.version() == 4 and s.read("id bigint").count() == 6
    assert s.clean() == [] and len(s.clean(older_than=0)) == 3 and s.read("id bigint").count() == 6


def test_one_of_two_writers_wins(spark, tmp_path):
    a, b = (Snapshots(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.write(spark.range(1))
    base = b.version()
    a.write(spark.range(2))
    with pytest.raises(ConcurrentWrite):
        b.versions.commit(base, [{"name": "x"}])
    assert a.read("id bigint").count() == 2


def test_stems_of_wanted_terms_only(spark):
    from tidemark.functions.text import porter, stem

    df = spark.createDataFrame([(1, "Falling falls", "", "hopping"), (2, "", None, "fall hope"), (3, None, None, None)], ITEMS)
    stems = [porter("falling"), porter("hoping")]
    counts, lengths = search.stemmed_index(df, ("title", "author", "content_text"), stem, stems)
    exp = search.index(search.postings(df, stemmer=stem))
    assert equal(counts, exp[0].where(F.col("term").isin(stems)).select("item_id", "term", "tf")) and equal(lengths, exp[1])


def test_counts_are_made_within_their_rows(spark):
    df = spark.createDataFrame([(1, "a b a", "é B", "a-a, c"), (2, None, "", "zz"), (3, None, None, None), (5, "x", None, "x y"), (4, "", "b", "b" * 3000 + " b")], ITEMS)
    made = search.counts(df)
    assert equal(made, search.index(search.postings(df))[0].select("item_id", "term", "tf"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_stems_are_counted_without_a_shuffle_of_terms(spark, monkeypatch):
    from tidemark.functions.text import porter, stem

    plans = []
    monkeypatch.setattr(search, "kept", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1])
    df = spark.createDataFrame([(1, "Falling falls", "", "hopping"), (2, "", None, "fall hope")], ITEMS)
    counts, _ = search.stemmed_index(df, ("title", "content_text"), stem, [porter("falling")])
    assert sorted(map(tuple, counts.collect())) == [(1, "fall", 2), (2, "fall", 1)]
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_what_a_task_gathers_of_a_term_is_bounded(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    index = StoredIndex(spark, f"file://{tmp_path}/index", ("title",), shards=2)
    index.insert(spark.range(0, 1 << 19, 1 << 12).selectExpr("id", "'same' as title"))
    groups = index._read(["same"]).groupBy("range").agg(F.sum("n").alias("n"), (F.max("last") - F.min("first")).alias("ids")).collect()
    assert len(groups) == 4 and all(g.n == 32 and g.ids < 1 << 17 for g in groups)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


@pytest.mark.parametrize("ranges", [2048, 0])
def test_marks_and_merges_with_and_without_bits(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(stored_index, "BIT_RANGES", ranges)
    r = random.Random(3)
    rows = [(k * 50_021 - 300, f"t{k % 5}", None, " ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(12)))) for k in range(120)]
    df = spark.createDataFrame(rows, ITEMS).cache()
    index = StoredIndex(spark, f"file://{tmp_path}/index", shards=3)
    index.insert(df.where("id % 2 = 0"))
    index.delete(df.where("id % 3 = 0"))
    index.insert(df.where("id % 5 = 0"))
    live = df.where("id % 2 = 0 and id % 3 <> 0 or id % 5 = 0")
    check(index, live)
    index.optimize()
    check(index, live)


def test_texts_and_postings_are_not_shuffled_for_marks(spark, tmp_path):
    rows = [(k, "", "", f"a b{k}") for k in range(50)]
    df = spark.createDataFrame(rows, ITEMS)
    index = StoredIndex(spark, f"file://{tmp_path}/index", shards=2)
    index.insert(df.where("id < 40"))
    index.delete(df.where("id < 9"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan(index.counts()) and "BroadcastHashJoin" in plan(index.counts())
    assert "SortMergeJoin" not in plan(index._held(df, False)) and index._held(df, False).count() == 19
