"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, small

#: So many most frequent tokens have their counts in the order's table, which has so many slots.
FREQUENT, SLOTS = 32_768, 1 << 18
#: A token that occurs more often than this is no key by itself.
HOT = 500
#: Lines of fewer tokens than the first have frequent tokens by threes as keys, of fewer than the second by twos, others one by one with their length.
BY_THREES, BY_TWOS = 20, 64
#: Larger sets have a sketch of twice the size.
NARROW = 64
#: Under a key of more lines than this, lines are first held against its earliest line.
CROWD = 512


#: White space inside a line, but for the space.
_SPACES = "\t\r\f\x0b"
_PLACE = ["doc", "at"]
_KEYED = ["key", "doc", "at", "np", "s1", "s2"]


def _row(text_col: str) -> Column:
    """Tells rows that share an id apart: 31 bits of the text's hash."""
    return F.shiftleft(F.xxhash64(text_col).bitwiseAND(F.lit((1 << 31) - 1)), 32)


def _spaced(text: Column) -> Column:
    """``text`` with spaces for other white space inside a line, so that a plain split finds the tokens."""
    spaced = reduce(lambda x, space: F.replace(x, F.lit(space), F.lit(" ")), _SPACES, text)
    return F.when(reduce(or_, (F.contains(text, F.lit(space)) for space in _SPACES)), spaced).otherwise(text)


def _hashes(line: Column) -> Column:
    """The hashes of the tokens of a line in lower case: they are parted by white space."""
    return F.array_remove(F.transform(F.split(_spaced(line), " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _places(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Lines of ``least`` tokens or more: ``doc, at, same, hs``.

    ``at`` holds the row's mark and the line's number from 0, so a place is ``doc, at``; ``same`` is a hash of the line in
    lower case, and ``hs`` are those of its distinct tokens.
    """
    # a generator's output is computed once; a filter on a plain column would be pushed down and split the line again
    return (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("doc"), _row(text_col).alias("row"), F.posexplode(F.split(F.lower(text_col), "\n")).alias("line", "raw"))
        .where(F.length(F.trim("raw")) > 0)
        .select("doc", F.col("row").bitwiseOR(F.col("line").cast("bigint")).alias("at"), F.xxhash64("raw").alias("same"), F.explode(F.array(_hashes(F.col("raw")))).alias("hs"))
        .where(F.size("hs") >= least)
        .withColumn("hs", F.array_distinct("hs"))
    )


def _frequencies(hs: DataFrame) -> tuple[Column, int]:
    """In how many lines the frequent tokens are, as a table by slot of the token's hash (0: not frequent), 40 bits to the left; and the most lines that any other token is in.

    Every token of every line is counted; the ``FREQUENT`` greatest counts reach the driver. A rare
    token in a frequent one's slot counts as frequent: that changes the order for every line alike.
    """
    top = hs.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(f"df > {HOT // 8}").orderBy(F.desc("df"), "h").limit(FREQUENT).collect()
    slots = [0] * SLOTS
    for r in top:
        slots[r.h % SLOTS] = max(slots[r.h % SLOTS], min(r.df, (1 << 22) - 1))
    return F.split(F.lit(",".join(str(n << 40) for n in slots)), ",").cast("array<bigint>"), top[-1].df if len(top) == FREQUENT else HOT // 8


def _distinct_lines(lines: DataFrame, slots: Column, percent: int) -> DataFrame:
    """Of equal lines the first: ``doc, at, n, rare, s1, s2, keys``.

    Tokens are ordered from rare to frequent, as values of count and hash. Two sets that are alike
    have ``percent`` % of either in common, so their first common token is among the first
    k = n - ceil(p n) + 1 of either, the second among one more, and the third among two more. A rare
    token of the first k is a key; ``rare`` says how many there are, and they come first. Where the first common token is
    a frequent one, only frequent ones follow: in short lines the first three together are a key, in longer
    ones the first two, and in long lines, whose k is large, each by itself with the band of the length: two
    lines that are alike are of one band or of neighbouring ones, and meet under the greater. Which of the three the longer of two lines
    asks for, the shorter has as well, so keys grow no faster than the line. A set that even one more token
    makes unlike (of one to three tokens at 80 %) is alike only if equal, and its key is the whole
    set. ``s1`` and ``s2`` are a parity sketch of the set; in sets of at most ``NARROW`` tokens all of it is in the first.
    """
    # values that can't be null are sorted as plain numbers
    rank = F.transform("hs", lambda h: F.coalesce(F.get(slots, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 24)), F.lit(0).cast("bigint")))
    threes = "flatten(flatten(transform(sequence(rare + 1, k), i -> transform(sequence(i + 1, k + 1), j -> transform(sequence(j + 1, k + 2), l -> xxhash64(element_at(t, i), element_at(t, j), element_at(t, l)))))))"
    twos = "flatten(transform(sequence(rare + 1, k), i -> transform(sequence(i + 1, k + 1), j -> xxhash64(element_at(t, i), element_at(t, j)))))"
    band = f"cast(floor(ln(n) / {math.log(100 / percent)!r}) as int)"
    ones = f"flatten(transform(slice(t, rare + 1, k - rare), x -> array(xxhash64(x, {band}), xxhash64(x, {band} + 1))))"
    none = "cast(array() as array<bigint>)"
    longer = f"(100 * n) div {percent}"
    keys = f"""
        if(n < 3 or 100 * n < {percent} * (n + 1), array(xxhash64(t)), if(rare = k, slice(t, 1, k), concat(
          slice(t, 1, rare),
          if(n < {BY_THREES}, {threes}, {none}),
          if({longer} >= {BY_THREES} and n < {BY_TWOS}, {twos}, {none}),
          if({longer} >= {BY_TWOS}, {ones}, {none}))))
    """
    return (
        lines.select("doc", "at", "same", F.sort_array(rank).alias("t")).withColumn("n", F.size("t"))
        .withColumn("k", F.expr(f"n - cast(({percent} * n + 99) div 100 as int) + 1"))
        .withColumn("rare", F.expr(f"if(element_at(t, k) < {HOT} * {1 << 40}L, k, size(filter(slice(t, 1, k), v -> v < {HOT} * {1 << 40}L)))"))
        .select(
            "doc", "at", "same", "n", "rare", F.expr(keys).alias("keys"),
            F.expr("aggregate(t, 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int)))").alias("all"),
            F.expr(f"if(n > {NARROW}, aggregate(filter(t, x -> x & 64L = 0L), 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int))), 0L)").alias("s2"),
        )
        .withColumn("s1", F.expr("all ^ s2"))
        .groupBy("same").agg(F.min(F.struct("doc", "at", "n", "rare", "s1", "s2", "keys")).alias("x")).select("x.*")
    )


def _keyed(distinct: DataFrame, *others: str) -> DataFrame:
    """A row for each key of a line: ``key, doc, at, np, s1, s2, p, rare`` and the ``others``; ``np`` holds the set's size and the first place that the key's first token can have."""
    return distinct.select(*_PLACE, "n", "rare", "s1", "s2", *others, F.posexplode("keys").alias("p", "key")).where("key is not null").select(
        "key", *_PLACE, F.expr("shiftleft(cast(n as bigint), 32) | (least(p, rare) + 1)").alias("np"), "s1", "s2", "p", "rare", *others
    )


def _fits(percent: int) -> str:
    """The length, positional and sketch filters that a candidate pair of key rows ``a`` and ``b`` has to pass."""
    n, pos = (lambda x: f"cast({x}.np >> 32 as int)"), (lambda x: f"cast({x}.np & 4294967295 as int)")
    total = f"({n('a')} + {n('b')})"
    need = f"(({percent} * {total} + {99 + percent}) div {100 + percent})"  # the overlap of sets that are alike
    return f"""
        100 * least({n('a')}, {n('b')}) >= {percent} * greatest({n('a')}, {n('b')})
        and 1 + least({n('a')} - {pos('a')}, {n('b')} - {pos('b')}) >= {need}
        and if(least({n('a')}, {n('b')}) > {NARROW}, bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2), bit_count(a.s1 ^ a.s2 ^ b.s1 ^ b.s2)) <= {total} - 2 * {need}
    """


def _token_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct token hashes of the ``wanted(doc, at)``, fetched from their texts: ``doc, at, hs``."""
    asked = cut(wanted.distinct().select("doc", _mark().alias("row"), _number().alias("line")).groupBy("doc", "row").agg(F.collect_list("line").alias("lines")))
    return cut(
        docs.select(F.col(id_col).alias("doc"), _row(text_col).alias("row"), F.col(text_col).alias("text")).join(small(asked, F.size("lines")), ["doc", "row"])
        .select("doc", "row", "lines", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "raw")).where(F.array_contains("lines", F.col("line")))
        .select("doc", F.col("row").bitwiseOR(F.col("line").cast("bigint")).alias("at"), "raw").dropDuplicates(_PLACE)
        .select("doc", "at", F.array_distinct(_hashes(F.col("raw"))).alias("hs"))
    )


def _alike(docs: DataFrame, pairs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The lines ``doc, at`` of the pairs ``doc, at, a_doc, a_at`` whose full sets are alike to that of ``a_doc, a_at``."""
    sets = _token_sets(docs, pairs.select(*_PLACE).union(pairs.select("a_doc", "a_at")), id_col, text_col)
    both = pairs.join(sets, _PLACE).join(sets.toDF("a_doc", "a_at", "hs_a"), ["a_doc", "a_at"])
    common = F.size(F.array_intersect("hs_a", "hs"))
    return cut(both.where(100 * common >= percent * (F.size("hs_a") + F.size("hs") - common)).select(*_PLACE).distinct())


def _crowded(met: DataFrame, others: int, percent: int) -> DataFrame:
    """The keys of more than ``CROWD`` lines.

    A rare token is in fewer than ``HOT`` lines, or is none of the counted ones, each of which is in at most ``others``; so it need be counted as a key only where one of these bounds is above ``CROWD``.
    """
    n = "(np >> 32)"
    other = f"p >= rare or {n} < 3 or 100 * {n} < {percent} * ({n} + 1)"
    return cut(met.where("true" if max(HOT, others) > CROWD else other).groupBy("key").agg(F.count("*").alias("members")).where(f"members > {CROWD}"))


def later_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Lines, each the first of its equals, that an earlier such line resembles: ``doc, at``.

    Candidates share a prefix key and pass the length filter, the positional filter and a parity
    sketch (its Hamming distance is at most the size of the symmetric difference); their texts are
    fetched and the full sets compared. One earlier line is enough for a line to go, so of the candidates of a line one in the
    first document that has any is compared, a row for each line, and pairs are never gathered. Under each key the earliest line is tried with
    every other first, which settles most of a group of many lines that are alike. Lines that this leaves are tried with all others of their keys that at most ``CROWD`` lines have.
    Only lines that are left then, and that have other candidates or a crowded key, are compared with every candidate before them.
    """
    slots, others = _frequencies(lines)
    distinct = cut(_distinct_lines(lines, slots, percent))
    discard(lines)
    met = _keyed(distinct)
    crowded = small(_crowded(met, others, percent))
    a, b = (F.struct(*(F.col(f"{x}.{c}") for c in _PLACE)) for x in "ab")

    def nearest(tried: DataFrame, *more: Column) -> DataFrame:
        """Of the candidates of a line one in the first document: at most one row for each line leaves a task."""
        return cut(tried.groupBy(*_PLACE).agg(F.min("a_doc").alias("a_doc"), F.min_by("a_at", "a_doc").alias("a_at"), *more))

    met = met.select(_KEYED)
    # column by column: a struct would go through the exchange as well
    by_place = Window.partitionBy("key").orderBy(*_PLACE)
    led = met.select(*_KEYED, *(F.first(c).over(by_place).alias(f"first_{c}") for c in _KEYED[1:])).select(
        F.struct(*_KEYED).alias("b"), F.struct(*(F.col(f"first_{c}").alias(c) for c in _KEYED[1:])).alias("a")
    )
    near = nearest(led.where((a < b) & F.expr(_fits(percent))).select(*(F.col(f"b.{c}") for c in _PLACE), *(F.col(f"a.{c}").alias(f"a_{c}") for c in _PLACE)))
    settled = _alike(docs, near, percent, id_col, text_col)
    discard(near)  # and the exchange that it was made from
    flagged = distinct.join(small(settled.withColumn("gone", F.lit(True)), F.lit(3)), _PLACE, "left")
    # of two sets that are alike the smaller (a) has 2p / (1 + p) of its own tokens in common, so of its first tokens fewer are enough;
    # said by the lesser of both sizes, so that both sides of the join read one exchange
    n = "least(a.np >> 32, b.np >> 32)"
    smaller = F.expr(f"(a.np & 4294967295) <= {n} - ({2 * percent} * {n} + {99 + percent}) div {100 + percent} + 1")
    ordered = F.expr("a.key = b.key") & (F.expr("a.np >> 32 < b.np >> 32") | (F.expr("a.np >> 32 = b.np >> 32") & (a < b)))
    some = _keyed(flagged, "gone").select(*_KEYED, F.coalesce("gone", F.lit(False)).alias("gone"))
    crowd = None
    if not crowded.isEmpty():
        some, crowd = some.join(crowded.select("key"), "key", "left_anti"), some.where("not gone").join(crowded.select("key"), "key")
    column = lambda of, c, name: F.when(a < b, F.col(f"{of[0]}.{c}")).otherwise(F.col(f"{of[1]}.{c}")).alias(name)
    left = F.when(a < b, ~F.col("b.gone")).otherwise(~F.col("a.gone"))
    tried = some.alias("a").join(some.alias("b"), ordered & smaller & left & F.expr(_fits(percent))).select(
        *(column("ba", c, c) for c in _PLACE), *(column("ab", c, f"a_{c}") for c in _PLACE), F.lit(False).alias("crowd")
    )
    if crowd is not None:
        tried = tried.union(crowd.select(*_PLACE, *(F.lit(None).cast("bigint") for _ in _PLACE), F.lit(True)).distinct())
    one = nearest(tried, F.max("crowd").alias("crowd"), F.expr("min(a_doc) < max(a_doc) or min(a_at) < max(a_at)").alias("more"))
    gone = _alike(docs, one.where("a_doc is not null").drop("crowd", "more"), percent, id_col, text_col)
    open_ = cut(one.where("more or crowd").join(small(gone, F.lit(2)), _PLACE, "left_anti").select(_PLACE))
    gone = settled.union(gone)
    if open_.isEmpty():
        return gone
    asked = cut(_keyed(distinct.join(small(open_, F.lit(2)), _PLACE)).select(_KEYED))
    pairs = (
        met.alias("a").join(small(asked, F.lit(len(_KEYED))).alias("b"), F.expr("a.key = b.key") & (a < b) & F.expr(_fits(percent)))
        .select(*(F.col(f"b.{c}") for c in _PLACE), *(F.col(f"a.{c}").alias(f"a_{c}") for c in _PLACE)).distinct()
    )
    return gone.union(_alike(docs, cut(pairs), percent, id_col, text_col))


def _mark() -> Column:
    return F.col("at").bitwiseAND(F.lit(((1 << 31) - 1) << 32))


def _number() -> Column:
    return F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least: int = 5) -> DataFrame:
    """Per document with any: ``doc, row, removed``, the sorted numbers (from 0) of the lines that go.

    Lines are in order of id and number. A line of at least ``least`` tokens (lower case, parted
    by white space) goes if any such line before it is equal in lower case or alike by ``percent`` %
    of the union of their token sets, whether that one stays or not. Equal lines are told by a
    64-bit hash, and so are tokens. Shorter lines and blank ones stay. ``percent`` is at least 67.

    Null texts have no lines; documents without an id keep all. Rows that share an id are told apart by ``row``, a mark of their text,
    and ordered by it; rows equal in id and text count as one, so they lose no line to each other. An empty table gives an empty table.
    """
    if percent < 67:
        raise ValueError("lines that are alike must have three tokens in common")
    places = _places(docs, id_col, text_col, least)
    lines = cut(places)
    held = cut(lines.select("doc", "at", "same"))
    later = later_lines(docs, lines, id_col, text_col, percent).withColumn("later", F.lit(True))
    first = held.groupBy("same").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).select("same", "n", "first.*")
    gone = first.join(later, _PLACE, "left").where("n > 1 or later").select("same", "later", F.struct("doc", "at").alias("first"))
    return (
        held.join(gone, "same").where(F.expr("later or struct(doc, at) <> first"))
        .select("doc", _mark().alias("row"), _number().alias("line")).distinct()
        .groupBy("doc", "row").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` less the lines that ``removed_lines`` names; all rows and columns stay.

    A document that loses every line has an empty text; a null text stays null.
    """
    gone = cut(removed_lines(docs, id_col, text_col, percent, least)).select(F.col("doc").alias("_tm_doc"), F.col("row").alias("_tm_row"), F.col("removed").alias("_tm_removed"))
    cols = docs.columns
    joined = docs.join(small(gone, F.size("_tm_removed") + 2), (F.col(id_col) == F.col("_tm_doc")) & (_row(text_col) == F.col("_tm_row")), "left")
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (w, i) -> not array_contains(_tm_removed, i)), '\\n')")
    return joined.withColumn(text_col, F.when(F.col("_tm_removed").isNull(), F.col(text_col)).otherwise(kept)).select(cols)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its number of lines, how many go, and which; lines of any number of tokens, blank ones left alone."""
    from tidemark.tables import table

    docs = table(spark, sf_dir, "documents")
    gone = cut(removed_lines(docs, least=1)).withColumnRenamed("doc", "doc_id")
    sizes = docs.select("doc_id", _row("text").alias("row"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    return sizes.join(gone, ["doc_id", "row"], "left").select(
        "doc_id", F.greatest("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )


#: The same by plain SQL: prefix lists in order of exact frequency, without the positional filter and the sketch.
OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS words FROM documents),
toks AS (
  SELECT doc_id, line, list_filter(string_split_regex(lower(words), '[ \t\x0B\f\r]+'), lambda w: w <> '') AS w FROM lines),
fit AS (SELECT doc_id, line, list_sort(list_distinct(w)) AS t FROM toks WHERE len(w) >= 1),
cls AS (SELECT t, min({'doc': doc_id, 'line': line}) AS first, row_number() OVER () AS id FROM fit GROUP BY t),
words AS (SELECT id, first, t, len(t) AS n, unnest(t) AS w FROM cls),
freq AS (SELECT w, count(*) AS df FROM words GROUP BY w),
ranked AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS pos FROM words JOIN freq USING (w)),
pre AS (SELECT id, n, w FROM ranked WHERE pos <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.w = b.w AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
alike AS (
  SELECT DISTINCT y.t AS t FROM cand JOIN cls x ON x.id = cand.a JOIN cls y ON y.id = cand.b
  WHERE x.first < y.first AND 100 * len(list_intersect(x.t, y.t)) >= 80 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))),
gone AS (
  SELECT f.doc_id, f.line FROM fit f JOIN cls c ON c.t = f.t LEFT JOIN alike k ON k.t = f.t
  WHERE k.t IS NOT NULL OR {'doc': f.doc_id, 'line': f.line} <> c.first),
per AS (SELECT doc_id, count(*) AS n, string_agg(line, ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(p.n, 0)::BIGINT AS n_removed, coalesce(p.removed, '') AS removed
FROM documents d LEFT JOIN per p USING (doc_id)
"""
