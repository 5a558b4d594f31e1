"""Golden values of scalar functions, and inputs that the supplied tables lack."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import htmlx, text
from tidemark.operators import store
from tidemark.plans import poll, search
from tidemark.queries import QUERIES
from tidemark.schema import config_from_json, config_to_json, split_valid_sources
from tidemark.sources import feeds, opml
from tidemark.sources.snapshots import Snapshots


def values(spark, kind, items, column):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)], f"i int, {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_intervals(spark):
    got = values(spark, "a bigint, b boolean", [(3600, True), (1000, True), (3600, False), (901, False), (14400, False), (21600, False), (100, False)], poll.next_interval(F.col("a"), F.col("b")))
    assert got == [1800, 900, 5400, 1351, 21600, 21600, 150]
    assert values(spark, "a bigint", [0, 1, 2, 3, 10, 11, 12], poll.backoff(F.col("a"))) == [60, 60, 120, 240, 30720, 61440, 86400]


URLS = {
    "http://a/x?utm_source=f": "http://a/x", "http://a/?b=2&a=1": "http://a/?b=2&a=1", "http://a/?b=2&utm_x=1&a=1": "http://a/?a=1&b=2", "http://a/?REF=1": "http://a/",
    "http://a/?reference=1": "http://a/?reference=1", "http://a/?utm_a=1#top": "http://a/#top", "http://a/#x?utm_a=1": "http://a/#x?utm_a=1",
}


@pytest.mark.parametrize("f", [text.strip_tracking, text.strip_tracking_full])
def test_strip(spark, f):
    assert values(spark, "u string", list(URLS), f(F.col("u"))) == list(URLS.values())
    assert values(spark, "u string", list(URLS.values()), f(F.col("u"))) == list(URLS.values())


def test_strip_encodes(spark):
    assert values(spark, "u string", ["http://a/?q=a%20b~*&utm_x=1&q=c"], text.strip_tracking_full("u")) == ["http://a/?q=a+b~%2A&q=c"]


def test_html_to_text(spark):
    got = values(spark, "h string", ["<b>foo</b>bar", "a&amp;b", "<p> x </p>", " a b ", "a\x0bb", "&eacute;&#65;", None], text.html_to_text(F.col("h")))
    assert got == ["foo bar", "a&b", "x", "a b", "a\x0bb", "éA", None]


def test_sanitize(spark):
    got = values(spark, "h string", ['<script>x</script><p onclick="a">b<a href="javascript:x" title="t">c</a></p><!-- d -->', '<a href="http://e">f</a>'], text.sanitize("h"))
    assert got == ['<p>b<a title="t">c</a></p>', '<a href="http://e">f</a>']


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("hoping", "hope"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll")])
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_links(spark):
    page = '<div id="n"><a href=" /a#x ">1</a><a href="#top">2</a><a href="javascript:x">3</a><a href="http://h:8/b">4</a><a href="http://h/c">5</a><a href="">6</a><a href="/a">7</a></div><a href="/z">8</a>'
    got = values(spark, "b string, m string, s string", [("http://h/p", page, "#n"), ("http://h/p", page, "..bad")], htmlx.page_links("b", "m", "s"))
    assert got == [["http://h/a", "http://h/c", "http://h/a"], ["http://h/a", "http://h/c", "http://h/a", "http://h/z"]]


def test_articles(spark):
    pages = ["<title> t </title><main>a<br>b</main>", '<div role="main"><i x="&lt;">c</i></div>', "<p>one</p><p>two", "&lt;b&gt;"]
    got = values(spark, "m string", pages, htmlx.by_rule("m"))
    assert [tuple(g) for g in got] == [("t", "a<br></br>b"), ("", '<i x="<">c</i>'), ("", "onetwo"), ("", "")]
    assert values(spark, "m string, s string", [("<ul><li class='k'>a</li></ul>", "ul .k"), ("<i>b</i>", "u")], htmlx.by_selector("m", "s")) == ["a", ""]


RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><guid isPermaLink="false">g1</guid><link>http://a/1?utm_x=1</link><title>T</title><description>d</description><content:encoded>&lt;p&gt;c&lt;/p&gt;</content:encoded><dc:creator>me</dc:creator><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item>
<item><link>http://a/2?ref=1</link><description>only</description></item><item><title>nothing</title></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>A</title><link rel="self" href="http://s"/><link href="http://a/3"/><updated>2024-01-02T00:00:00Z</updated><summary>s</summary><author><name>n</name></author></entry></feed>'


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<rss><channel>")], "source_id bigint, body string")
    got = {r.guid: r for r in feeds.entry_items(feeds.entries(df), 99).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {sha("g1"), sha("http://a/2?ref=1"), sha("i")}
    a, b, c = got[sha("g1")], got[sha("http://a/2?ref=1")], got[sha("i")]
    assert (a.url, a.author, a.published_at, a.content_html, a.content_text) == ("http://a/1", "me", 1704164645, "<p>c</p>", "c")
    assert (b.url, b.published_at, b.content_text, b.title) == ("http://a/2", 99, "only", "")
    assert (c.url, c.published_at, c.author, c.content_text) == ("http://a/3", 1704153600, "n", "s")
    assert [r.source_id for r in feeds.malformed(df).collect()] == [3]


def test_selector_pages_have_no_title(spark):
    df = spark.createDataFrame([(1, "http://a/?utm_x=1", "<title>t</title><b>x</b>", "b")], "source_id bigint, url string, html string, content_selector string")
    r = feeds.page_items(df, 5).first()
    assert (r.title, r.guid, r.content_text) == ("", hashlib.sha256(b"http://a/").hexdigest(), "x")


def test_state_transitions(spark):
    df = spark.createDataFrame([(1, 10, 1, True, None), (1, 20, 2, True, True), (1, 30, 3, False, None), (2, 5, 4, None, None)], "item_id bigint, ts bigint, seq bigint, is_read boolean, is_starred boolean")
    got = {r.item_id: r for r in store.fold_states(df).collect()}
    assert (got[1].is_read, got[1].read_at, got[1].is_starred, got[1].starred_at, got[1].updated_at) == (False, None, True, 20, 30)
    assert (got[2].is_read, got[2].read_at) == (False, None)


def test_depths(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 9)], "id bigint, parent_id bigint")
    assert dict(store.folder_depths(df).collect()) == {1: 0, 2: 1, 3: 2, 9: 11}
    ok, bad = store.split_new_folders(df, spark.createDataFrame([("a", 2), ("b", 3), ("", None), ("c", None)], "name string, parent_id bigint"))
    assert {r.name for r in ok.collect()} == {"a", "c"} and {r.reason for r in bad.collect()} == {"too deep", "name is required"}


def test_months(spark):
    assert [str(x) for x in values(spark, "d string", ["2024-05-31", "2023-05-31", "2024-03-15"], store.months_back(F.to_date("d"), 3))] == ["2024-03-02", "2023-03-03", "2023-12-15"]


def test_fold_in_parts_is_the_fold(spark):
    outcomes = ["new", "none", "failed", "failed", "unchanged", "failed", "gone", "new"]
    df = spark.createDataFrame([(1, i, 100 * i, o) for i, o in enumerate(outcomes)], "source_id bigint, seq bigint, ts bigint, outcome string")
    whole = poll.fold_polls(df).first()
    half = poll.fold_polls(df.where("seq < 4")).first()
    start = f"named_struct('interval', {half.interval}L, 'next_poll_at', {half.next_poll_at}L, 'fails', {half.fails}L, 'dead', {str(half.dead).lower()})"
    assert poll.fold_polls(df.where("seq >= 4"), start).first() == whole
    assert whole.dead and whole.fails == 2


def test_no_row_gathers_a_group(spark):
    log = spark.range(300_000).selectExpr("if(id % 3 = 0, 1L, id % 50) as source_id", "id as seq", "id as ts", "case id % 7 when 0 then 'new' when 1 then 'failed' else 'none' end as outcome")
    patches = log.selectExpr("source_id as item_id", "ts", "seq", "seq % 3 = 0 as is_read", "if(seq % 5 = 0, null, seq % 2 = 0) as is_starred")
    for df in (poll.fold_polls(log), store.fold_states(patches)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "aggregate(" not in plan.replace("Aggregate", "")
    states = {}
    for r in log.orderBy("seq").collect():
        states[r.source_id] = poll.step(states.get(r.source_id, (3600, 0, 0, False)), r.ts, r.outcome)
    assert {r[0]: tuple(r)[1:] for r in poll.fold_polls(log).collect()} == states
    flags = {}
    for r in patches.orderBy("seq").collect():
        read, star, read_at, star_at, _ = flags.get(r.item_id, (False, False, None, None, 0))
        read_at = read_at if r.is_read is None else (r.ts if read_at is None else read_at) if r.is_read else None
        star_at = star_at if r.is_starred is None else (r.ts if star_at is None else star_at) if r.is_starred else None
        flags[r.item_id] = (read if r.is_read is None else r.is_read, star if r.is_starred is None else r.is_starred, read_at, star_at, r.ts)
    assert {r.item_id: tuple(r)[1:] for r in store.fold_states(patches).collect()} == flags


def test_outcomes(spark):
    rows = [("rss", 200, 1, True), ("rss", 200, 0, True), ("rss", 304, 0, None), ("rss", 410, 0, None), ("rss", 200, 0, False), ("html", 304, 0, None), ("html", 404, 0, None), ("html", 200, 2, True)]
    assert values(spark, "k string, s int, n int, p boolean", rows, poll.outcome(F.col("k"), F.col("s"), F.col("n"), F.col("p"))) == ["new", "none", "unchanged", "gone", "failed", "failed", "failed", "new"]


def test_validation(spark):
    cfg = "scraper_config struct<index_selector: string, date_selector: string, content_selector: string>"
    df = spark.createDataFrame([("u", "rss", None, 1), ("", "rss", None, 1), ("u", "x", None, 1), ("u", "html", None, 1), ("u", "html", ("a", None, None), None), ("u", "rss", None, 0)], f"url string, type string, {cfg}, poll_interval bigint")
    ok, bad = split_valid_sources(df)
    assert ok.count() == 2 and bad.count() == 4
    assert df.where("scraper_config is not null").select(config_from_json(config_to_json(F.col("scraper_config"))).alias("c")).first().c.index_selector == "a"
    with pytest.raises(ValueError):
        search.top(df, 501)
    with pytest.raises(search.EmptyQuery):
        search.bm25(df, df, [])


def test_outline_document(spark):
    src = spark.createDataFrame([(1, "rss", "http://a?x&y", "A<b", None), (2, "html", "http://c", "C", 7)], "id bigint, type string, url string, title string, folder_id bigint")
    xml = opml.document(opml.export(src, spark.createDataFrame([(7, "F"), (8, "empty")], "id bigint, name string")), "t").first().xml
    assert '<outline text="A&lt;b" title="A&lt;b" type="rss" xmlUrl="http://a?x&amp;y"/><outline text="F" title="F"><outline text="C" title="C" xmlUrl="http://c"/></outline>' in xml


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    assert s.read("id bigint").count() == 0
    s.write(spark.range(3))
    s.write(s.read("id bigint").where("id > 0"), files=1)
    assert s.version() == 2 and s.read("id bigint").count() == 2


def test_upsert_twice_is_once(spark):
    batch = spark.createDataFrame([(1, 1, "g"), (2, 1, "g"), (3, 2, "g")], "id bigint, source_id bigint, guid string")
    once = store.upsert_items(batch.limit(0), batch)
    assert {r.id for r in once.collect()} == {1, 3} and store.upsert_items(once, batch).count() == 0


PAGES_CUT = [(1, "http://h/1", "<title>a &amp;&amp</title><article><h1>a &amp;&amp</h1><p>b&quo &quot;c&quot &amp;d;&#65;&#65</p></article>"), (2, "http://h/2", "<title>&ampx; &lt</title><article>&ampx; x</article>")]


def pages_cut(spark, tmp_path):
    spark.createDataFrame(PAGES_CUT, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_html_rule_keeps_references_without_semicolon_as_its_sql(spark, tmp_path):
    sf = pages_cut(spark, tmp_path)
    got = {r.page_id: (r.title, r.content_text) for r in QUERIES["html_rule"](spark, sf).collect()}
    assert got == {1: ("a &&amp", 'a &&amp b&quo "c&quot &d;A&#65'), 2: ("&ampx; &lt", "&ampx; x")}


def test_html_selector_keeps_references_without_semicolon_as_its_sql(spark, tmp_path):
    got = {r.page_id: r.content_text for r in QUERIES["html_selector"](spark, pages_cut(spark, tmp_path)).collect()}
    assert got == {1: 'a &&amp b&quo "c&quot &d;A&#65', 2: "&ampx; x"}


def test_page_items_may_keep_references_without_semicolon(spark):
    df = spark.createDataFrame([(1, "http://a/", PAGES_CUT[0][2], ""), (2, "http://a/", PAGES_CUT[0][2], "article")], "source_id bigint, url string, html string, content_selector string")
    got = {r.source_id: (r.title, r.content_text) for r in feeds.page_items(df, 5, closed=True).collect()}
    assert got == {1: ("a &&amp", 'a &&amp b&quo "c&quot &d;A&#65'), 2: ("", 'a &&amp b&quo "c&quot &d;A&#65')}
    assert feeds.page_items(df, 5).where("source_id = 1").first().title == "a &&"  # as browsers


def test_page_round_keeps_references_without_semicolon_as_its_sql(spark, tmp_path):
    got = {r.source_id: (r.title, r.content_text) for r in QUERIES["page_round_items"](spark, pages_cut(spark, tmp_path)).collect()}
    assert got == {1: ("a &&amp", 'a &&amp b&quo "c&quot &d;A&#65'), 2: ("", "&ampx; x")}


def test_python_gets_few_pages_at_once(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    QUERIES["html_sanitize"](spark, pages_cut(spark, tmp_path)).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
