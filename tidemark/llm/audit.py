"""Filter interaction audit: what filters remove alone and in every order, by unions and differences of sorted lists of failing rows."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.words import text_slices

UPPER, SYMBOLS, INNER = bytes(range(0x41, 0x5B)), b"#$%&*|", bytes(range(0x80, 0xC0))
FILTERS = "ABCDE"
#: Rows of a block of lists, and ids that are looked up in one window.
BLOCK, WINDOW = 1 << 16, 256


def words_of(raw: bytes, size: int = 1 << 22) -> tuple[int, int]:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has and how many distinct ones, in pieces of about ``size`` bytes that end at white space."""
    if len(raw) <= size:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, a = 0, set(), 0
    while a < len(raw):
        b = min((k for k in (raw.find(c, a + size) for c in b" \t\n\r\x0b\x0c") if k >= 0), default=len(raw))
        words = raw[a:b].split()
        n, a = n + len(words), b
        seen.update(words)
    return n, len(seen)


def failures(raw: bytes) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    n, distinct = words_of(raw)
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        (n < 100) | (100 * distinct < 80 * n) << 1 | (100 * upper > 10 * len(raw.translate(None, INNER))) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def _judge(batches):
    for batch in batches:
        for a, b, texts in text_slices(batch.column(2).cast(pa.binary())):
            raw = [t or b"" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([failures(t) for t in raw], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in raw])],
                names=["doc_id", "part", "fails", "digest"],
            )


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, fails, good, toxic`` for every document: the failed filters as bits 0 to 4, and whether a label calls it good or toxic.

    E: a document of smaller id has the same text, by SHA-256. The first id of each text is an aggregate that is reduced before it is shuffled, and rows meet it
    by id and digest, so that a text that many have is no hot key. A row without an id fails E never. An id counts as good or toxic if any of its labels says so.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    slim = cut(rows.mapInArrow(_judge, "doc_id bigint, part string, fails int, digest binary"))
    known = slim.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    ).where("good or toxic")
    own = slim.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return own.select("doc_id", "part", F.col("fails").bitwiseOR(again).alias("fails"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def gallop(many: np.ndarray, lo: int, x: int) -> tuple[int, int]:
    """A range of ``many``, from ``lo`` on, in which ``x`` has its place: steps double until one is not below ``x``."""
    reach, step = lo, 1
    while reach < len(many) and many[reach] < x:
        lo, reach, step = reach, reach + step, 2 * step
    return lo, min(reach + 1, len(many))


def places(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where each of ``few`` stands or would stand in ``many``, both sorted: from window to window of ``few``, ``many`` is galloped over."""
    out, lo = np.empty(len(few), np.int64), 0
    for a in range(0, len(few), WINDOW):
        window = few[a : a + WINDOW]
        lo, _ = gallop(many, lo, window[0])
        _, hi = gallop(many, lo, window[-1])
        found = lo + np.searchsorted(many[lo:hi], window)
        out[a : a + WINDOW], lo = found, int(found[-1])
    return out


def holds(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``few`` are in ``many``."""
    if not len(many):
        return np.zeros(len(few), bool)
    at = places(few, many)
    return many[np.minimum(at, len(many) - 1)] == few


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted lists without repetition merged to one: the shorter one's new ids are put in their places in the longer one."""
    few, many = sorted((a, b), key=len)
    if not len(few):
        return many
    at = places(few, many)
    new = (at == len(many)) | (many[np.minimum(at, len(many) - 1)] != few)
    return np.insert(many, at[new], few[new])


def _lists(batches):
    """Rows sorted by part and id to blocks: the ids of a block's failing rows, and by filter and label the numbers of the rows that it holds of."""
    for batch in batches:
        part = batch.column(1).to_pylist()
        bits = [np.flatnonzero(np.asarray(batch.column(2)) >> k & 1) for k in range(len(FILTERS))] + [np.flatnonzero(batch.column(c).to_numpy(zero_copy_only=False)) for c in (3, 4)]
        edges = [k for k in range(len(part)) if not k or part[k] != part[k - 1]] + [len(part)]
        cuts = [c for a, b in zip(edges[:-1], edges[1:], strict=True) for c in range(a, b, BLOCK)] + [len(part)]
        rows = [[part[a], batch.column(0)[a:b].to_pylist(), *(list_[np.searchsorted(list_, a) : np.searchsorted(list_, b)] - a for list_ in bits)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kinds = [pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 7]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["part", "ids", *FILTERS, "good", "toxic"])


def posting_lists(rows: DataFrame) -> DataFrame:
    """``part, ids, A .. E, good, toxic``: a part's failing rows in blocks of an id range.

    ``ids`` is sorted; the others are sorted lists of places in ``ids``, which tell rows that share an id, or have none, apart. Rows are dealt by ranges of part and id,
    so that a part with a third of all rows is in many tasks; a block has at most ``BLOCK`` rows.
    """
    failing = cut(rows.where("fails <> 0"))  # dealing by ranges looks at the rows twice
    dealt = failing.select("doc_id", "part", "fails", "good", "toxic").repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    places_ = "array<int>"
    return dealt.mapInArrow(_lists, f"part string, ids array<bigint>, {', '.join(f'{f} {places_}' for f in FILTERS)}, good {places_}, toxic {places_}")


def _sizes(batches):
    """For each block, each set of filters and each filter outside of it: how many the filter removes after the set, and how many of those are good or toxic."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            part = batch.column(0)[k].as_py()
            lists = [batch.column(c)[k].values.to_numpy() for c in range(2, 9)]
            good, toxic = lists[5:]
            unions = [np.zeros(0, np.int32)]
            for s in range(1, 32):
                top = s.bit_length() - 1
                unions.append(union(unions[s & ~(1 << top)], lists[top]))
            for s in range(32):
                for f in range(5):
                    if not s >> f & 1:
                        left = lists[f][~holds(lists[f], unions[s])]
                        out.append((part, s, f, len(left), int(holds(left, good).sum()), int(holds(left, toxic).sum())))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "before", "f", "removed", "good_lost", "toxic_lost"])


def removals(lists: DataFrame) -> DataFrame:
    """``part, before, f, removed, good_lost, toxic_lost``: what filter ``f`` removes of a part after the set ``before`` (as bits), 80 rows a part.

    Unions and differences are merged block by block; as id ranges do not meet, sizes add up.
    """
    sized = lists.mapInArrow(_sizes, "part string, before int, f int, removed bigint, good_lost bigint, toxic_lost bigint")
    return sized.groupBy("part", "before", "f").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))


def audit(rows: DataFrame) -> DataFrame:
    """Every part, order of the filters and step, from ``rows(doc_id, part, fails, good, toxic)``; zeros included, see ``op13_filter_audit``.

    What a step removes depends on the set of filters before it alone, so each part has a map of its 80 sizes; an order keeps what none of its steps so far removed.
    """
    bit, every = {f: 1 << k for k, f in enumerate(FILTERS)}, (1 << len(FILTERS)) - 1
    plan = []
    for order in permutations(FILTERS):
        sets = [sum(bit[x] for x in order[:k]) for k in range(len(order))]
        keys = [8 * s + FILTERS.index(f) for s, f in zip(sets, order, strict=True)]
        plan += [("".join(order), k + 1, FILTERS.index(f), keys[: k + 1], 8 * (every - bit[f]) + FILTERS.index(f)) for k, f in enumerate(order)]
    steps = F.broadcast(rows.sparkSession.createDataFrame(plan, "filter_order string, step int, f int, keys array<int>, alone int"))  # 600 rows
    size = F.struct("removed", "good_lost", "toxic_lost").alias("size")
    maps = removals(posting_lists(rows)).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct((F.col("before") * 8 + F.col("f")).alias("key"), size))).alias("sizes"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), *(F.count_if(F.col("fails").bitwiseAND(1 << k) != 0).alias(f"n{k}") for k in range(len(FILTERS))))
    full = cut(parts.join(maps, "part", "left")).select("part", "n", "sizes", F.posexplode(F.array(*(f"n{k}" for k in range(len(FILTERS))))).alias("f", "failing"))
    of = lambda key, what="removed": F.coalesce(F.try_element_at("sizes", key).getField(what), F.lit(0)).cast("bigint")
    now, total = F.element_at("keys", -1), lambda keys, value: F.aggregate(keys, F.lit(0).cast("bigint"), lambda x, key: x + value(key))
    weight = lambda key: F.element_at(F.array(*(F.lit(w) for w in (24, 6, 4, 6, 24))), F.bit_count(F.floor(key / 8)) + 1)  # noqa: E731  orders with just this set before the filter
    every_set = F.array(*(F.lit(s * 8) for s in range(every + 1)))
    before = F.transform(F.filter(every_set, lambda s: F.floor(s / 8 / F.pow(F.lit(2), F.col("f"))) % 2 == 0), lambda s: s + F.col("f"))
    return full.join(steps, "f").select(
        "part", "filter_order", "step", (F.col("n") - total(F.col("keys"), of)).alias("kept"), of(now).alias("removed"), (F.col("failing") - of(now)).alias("redundant"), of(F.col("alone")).alias("unique_fails"),
        of(now, "good_lost").alias("good_lost"), of(now, "toxic_lost").alias("toxic_lost"), total(before, lambda key: of(key) * weight(key)).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over every whole text, in all 120 orders, for each language: one row a part, order and step.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % of A-Z; D: any of ``#$%&*|``; E: the text of a smaller id. A null or empty text is empty
    and fails A; a null language is the part ''. Rows that share an id are judged one by one; an empty table gives an empty table; other columns are ignored.
    """
    from tidemark.tables import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(cut(judged(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))))


_BITS = " | ".join(f"(CASE WHEN {c} THEN {1 << k} ELSE 0 END)" for k, c in enumerate((
    "len(w) < 100", "100 * len(list_distinct(w)) < 80 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)", "regexp_matches(t, '[#$%&*|]')", "doc_id > first",
)))
OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {_BITS} AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
o(filter_order, used, k) AS (
  SELECT '', 0, 0 UNION ALL SELECT filter_order || substr('ABCDE', f + 1, 1), used | (1 << f), k + 1 FROM o, range(5) r(f) WHERE used & (1 << f) = 0 AND k < 5),
s AS (SELECT filter_order, i AS step, instr('ABCDE', substr(filter_order, i, 1)) - 1 AS f,
    list_sum([1 << (instr('ABCDE', substr(filter_order, j, 1)) - 1) for j in range(1, i)]) AS before FROM o, range(1, 6) r(i) WHERE k = 5),
g AS (SELECT part, filter_order, step, f, sum(n) FILTER (fails & (coalesce(before, 0)::BIGINT | (1 << f)) = 0) AS kept, sum(n) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0)::BIGINT = 0) AS removed,
    sum(n) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0)::BIGINT <> 0) AS redundant, sum(n) FILTER (fails = 1 << f) AS unique_fails,
    sum(good) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0)::BIGINT = 0) AS good_lost, sum(toxic) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0)::BIGINT = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM g
"""
