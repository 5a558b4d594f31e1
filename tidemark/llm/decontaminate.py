"""Benchmark decontamination: a BM25 index of test items, searched with every training passage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, mix, slices, text_slices

K1, B = 1.2, 0.75
#: Items of a posting block, whose greatest impacts bound what the block can score.
BLOCK = 4
#: Characters of items in one index, whose arrays take about ten bytes for each; more items than that make several indexes, searched in turn.
INDEX_CHARS = 2_000_000
#: So many maxima are kept as a table as well, which is faster to look up.
DENSE = 1 << 20
#: Bounds that are looked up at once.
LOOKUPS = 1 << 19


@dataclass
class Index:
    """Postings of the items' terms: impacts are shares of the score that an item gives itself."""

    item_ids: list
    longest: int
    terms: np.ndarray  # ascending term hashes
    first: np.ndarray  # of each term in items and impacts, one more at the end
    items: np.ndarray
    impacts: np.ndarray
    block_at: np.ndarray  # of each term and block with it: term * blocks + block, ascending
    block_max: np.ndarray  # the greatest impact of each of those
    block_first: np.ndarray  # where the postings of each of those begin, one more at the end
    blocks: int
    dense: np.ndarray | None  # the same as a table of terms and blocks, where it has at most DENSE cells
    parts: list[tuple[np.ndarray, np.ndarray, int]]  # question's and answer's grams, and their width
    named: tuple | None = None  # what ``essential`` gave last, and for which score


def bounds(index: Index, terms: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The greatest impact that each term has in each block, 0 where it has none."""
    if index.dense is not None:
        return index.dense[terms, blocks]
    want = terms.astype(np.int64) * index.blocks + blocks
    at = np.minimum(np.searchsorted(index.block_at, want), len(index.block_at) - 1)
    return np.where(index.block_at[at] == want, index.block_max[at], 0.0)


def essential(index: Index, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each term the blocks that it alone makes worth a look: where each term's begin, with the end, and the blocks.

    A block's terms are ordered by their greatest impact. What matches the block with ``least`` or more has a first of these terms, and
    that term and all after it have maxima that sum up to ``least`` at least. Other terms, the common ones above all, name no block by themselves.
    """
    term, block = np.divmod(index.block_at, index.blocks)
    order = np.lexsort((-index.block_max, block))
    sums = np.cumsum(index.block_max[order][::-1])[::-1]
    ends = np.searchsorted(block[order], np.arange(index.blocks), "right")
    after = np.append(sums, 0.0)[ends]
    keep = np.zeros(len(order), bool)
    keep[order] = sums - after[block[order]] >= least - 1e-9
    return np.searchsorted(term[keep], np.arange(len(index.terms) + 1)), block[keep]


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of runs of ``width`` words."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    value = np.zeros(len(hashes) - width + 1, np.uint64)
    for j in range(width):
        value += hashes[j : j + len(value)] * (mix(np.array([j + 1], np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1))
    return np.unique(mix(value))


def split_item(n: int) -> int:
    """Where an item's answer begins: at its last quarter, at five words at least; 0 if too short to have two parts."""
    tail = max(5, n // 4)
    return n - tail if n - tail >= 5 else 0


def build(rows: list[tuple[int, str]], total: int, df: dict[int, int], mean: float, percent: int = 100, least: float = 1.0) -> Index:
    """An index of items ``(id, text)``; the corpus has ``total`` items of ``mean`` words, ``df`` of them with a term.

    A text with ``percent`` % of the distinct word runs of both parts of an item lacks no more of its distinct words than of these runs
    (a missing word is missing from as many runs). Where the heaviest words of that number are worth so much that the rest is below
    ``least`` of the item's own score, the item's impacts are shares of a smaller one, of which the rest is ``least``: so no such text is missed.
    """
    w = Words([t for _, t in rows], plain=True)
    per: dict[int, list[tuple[int, float]]] = {}
    parts, longest = [], 5
    for i in range(len(rows)):
        h = w.hash[w.first[i] : w.first[i + 1]]
        longest = max(longest, len(h))
        kinds, tf = np.unique(h, return_counts=True)
        own = []
        for t, f in zip(kinds.tolist(), tf.tolist(), strict=True):
            d = df[t]
            idf = max(np.log((total - d + 0.5) / (d + 0.5)), 1e-6)
            own.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(h) / mean)))
        cut, width = split_item(len(h)), min(5, max(1, len(h)))
        parts.append((grams(h[:cut], width), grams(h[cut:], width), width))
        lacking = sum(len(x) * (100 - percent) // 100 for x in parts[-1][:2])
        whole = min(sum(own), max(sum(sorted(own)[: len(own) - lacking]), min(own)) / least) if own else 0.0
        for t, x in zip(kinds.tolist(), own, strict=True):
            per.setdefault(t, []).append((i, x / whole))
    terms = np.array(sorted(per), np.uint64)
    lists = [per[t] for t in sorted(per)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    items = np.array([i for x in lists for i, _ in x], np.int64)
    impacts = np.array([v for x in lists for _, v in x])
    blocks = -(-len(rows) // BLOCK)
    at = np.repeat(np.arange(len(terms)), np.diff(first)) * blocks + items // BLOCK  # ascending, as items are within a term
    new = np.flatnonzero(np.diff(at, prepend=-1))
    tops, dense = np.maximum.reduceat(impacts, new), None
    if len(terms) * blocks <= DENSE:
        dense = np.zeros((len(terms), blocks))
        dense.ravel()[at[new]] = tops
    return Index([i for i, _ in rows], longest, terms, first, items, impacts, at[new], tops, np.append(new, len(at)), blocks, dense, parts)


def wand(index: Index, block: int, terms: np.ndarray, least: float) -> list[int]:
    """Items of a block that score ``least`` or more against the distinct ``terms`` of a passage.

    Lists are kept by their next item; the pivot is the first at which the bounds of the lists up to
    it reach ``least``. Items before the pivot are skipped; an item at it is scored.
    """
    want = terms.astype(np.int64) * index.blocks + block
    at = np.minimum(np.searchsorted(index.block_at, want), len(index.block_at) - 1)
    at = at[index.block_at[at] == want]
    size = index.block_first[at + 1] - index.block_first[at]
    end = np.cumsum(size)
    postings = np.repeat(index.block_first[at] - end + size, size) + np.arange(size.sum())
    items, impacts = index.items[postings].tolist(), index.impacts[postings].tolist()
    lists = [[items[b - n], top, b - n, b] for top, n, b in zip(index.block_max[at].tolist(), size.tolist(), end.tolist(), strict=True)]
    found = []
    while lists:
        lists.sort()
        bound, pivot = 0.0, None
        for x in lists:
            bound += x[1]
            if bound >= least:
                pivot = x[0]
                break
        if pivot is None:
            break
        if lists[0][0] == pivot:
            if sum(impacts[x[2]] for x in lists if x[0] == pivot) >= least:
                found.append(pivot)
            goal = pivot + 1
        else:
            goal = pivot
        for x in lists:
            if x[0] < goal:
                while x[2] < x[3] and items[x[2]] < goal:
                    x[2] += 1
                x[0] = items[x[2]] if x[2] < x[3] else -1
        lists = [x for x in lists if x[2] < x[3]]
    return found


def search(index: Index, w: Words, least: float, whole: bool = False) -> list[tuple[int, int]]:
    """Pairs (text, item) of which a passage of the text scores ``least`` or more of the item's own score.

    Passages overlap by the longest item, so that a copy of an item is whole in one of them. With ``whole``, a text of several passages
    is one more passage itself, which finds items whose parts are far from each other. The essential terms of a
    passage name the blocks to look at; of these, blocks whose maxima over all terms of the passage do not reach ``least`` are skipped,
    and only the rest are searched item by item.
    """
    if not len(w.hash) or not len(index.terms):
        return []
    at = np.minimum(np.searchsorted(index.terms, w.hash), len(index.terms) - 1)
    where = np.flatnonzero(index.terms[at] == w.hash)
    if not len(where):
        return []
    term = at[where]
    counts = np.diff(w.first)
    text = np.repeat(np.arange(len(counts)), counts)[where]
    place = where - w.first[text]
    stride = max(64, index.longest)
    rows = -(-np.maximum(counts, 1) // stride)
    base = np.cumsum(rows) - rows
    order = np.lexsort((place, term, text))
    same = np.zeros(len(order), bool)
    same[1:] = (term[order][1:] == term[order][:-1]) & (text[order][1:] == text[order][:-1])
    before = np.full(len(order), -1)
    before[order[1:][same[1:]]] = place[order[:-1][same[1:]]]
    cells, kinds = [], []
    for back in (0, 1):  # the passage that begins in a word's own stride, and the one before
        start = (place // stride - back) * stride
        ok = (start >= 0) & (before < start) & (place < start + stride + index.longest)
        cells.append((base[text] + place // stride - back)[ok])
        kinds.append(term[ok])
    passages = int(rows.sum())
    if whole:  # numbered after the passages, by text
        ok = order[~same & (rows[text[order]] > 1)]
        cells.append(passages + text[ok])
        kinds.append(term[ok])
    cell, kind = np.concatenate(cells), np.concatenate(kinds)
    by = np.argsort(cell, kind="stable")  # ascending runs
    cell, kind = cell[by], kind[by]
    if index.named is None or index.named[0] != least:
        index.named = (least, *essential(index, least))
    _, first, blocks = index.named
    n = first[kind + 1] - first[kind]
    named = np.repeat(first[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs = np.unique(np.repeat(cell, n) * index.blocks + blocks[named])
    hit: list[tuple[int, int]] = []
    begin, end = np.searchsorted(cell, pairs // index.blocks), np.searchsorted(cell, pairs // index.blocks, "right")
    taken = np.cumsum(end - begin)
    for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.unique(np.append(np.searchsorted(taken, np.arange(0, (taken[-1] if len(taken) else 0) + 1, LOOKUPS)), [0, len(pairs)]))), strict=True):
        size = (end - begin)[lo:hi]
        which = np.repeat(np.arange(hi - lo), size)
        terms = kind[np.repeat(begin[lo:hi] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        total = np.bincount(which, bounds(index, terms, (pairs[lo:hi] % index.blocks)[which]), hi - lo)
        for k in (lo + np.flatnonzero(total >= least - 1e-9)).tolist():
            passage, block = divmod(int(pairs[k]), index.blocks)
            for item in wand(index, block, kind[begin[k] : end[k]], least - 1e-9):
                hit.append((passage - passages if passage >= passages else int(np.searchsorted(base, passage, "right")) - 1, item))
    return sorted(set(hit))


def leaking(index: Index, w: Words, percent: int, least: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Leaks among the texts: text, item, how many of the question's word runs the text has, of how many, and the same of the answer."""
    of, own = -1, {}
    for text, item in search(index, w, least, True):
        if text != of:  # pairs come by text
            of, own = text, {}
        question, answer, width = index.parts[item]
        if width not in own:
            own[width] = grams(w.hash[w.first[text] : w.first[text + 1]], width)
        q, r = (int((own[width][np.searchsorted(own[width][:-1], x)] == x).sum()) if len(own[width]) else 0 for x in (question, answer))
        if 100 * q >= percent * len(question) and 100 * r >= percent * len(answer):
            yield text, item, q, len(question), r, len(answer)


def indexes(items: DataFrame, percent: int, least: float, id_col: str = "item_id", text_col: str = "text") -> Iterator[Broadcast]:
    """Indexes of all items, each of at most about ``INDEX_CHARS`` characters and sent to the executors once; statistics are over all items."""
    known = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    if not total.n:
        return
    blocks = -(-total.chars // INDEX_CHARS) or 1

    def terms(batches):
        for batch in batches:
            for a, b in slices(texts := batch.column(0).to_pylist()):
                w = Words(texts[a:b], plain=True)
                of = np.repeat(np.arange(b - a), np.diff(w.first))
                both = np.unique(np.stack([of.astype(np.uint64), w.hash]), axis=1) if len(of) else np.zeros((2, 0), np.uint64)
                kinds, n = np.unique(both[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.full(len(kinds), 0, np.int64))], names=["h", "n", "words"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([len(w.hash)], pa.int64())], names=["h", "n", "words"])

    stats = known.select("t").mapInArrow(terms, "h bigint, n bigint, words bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    mean = max(1.0, stats.where("h is null").first().words / total.n)
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        rows = [(r.i, r.t) for r in rows if r.t.split()]
        if not rows:
            continue
        own = np.unique(Words([t for _, t in rows], plain=True).hash).view(np.int64).tolist()
        if blocks == 1:
            df = {r.h & (2**64 - 1): r.n for r in stats.where("h is not null").collect()}
        else:
            wanted = items.sparkSession.createDataFrame([(h,) for h in own], "h bigint")
            df = {r.h & (2**64 - 1): r.n for r in stats.join(wanted, "h").collect()}
        rows = [r for r in rows if len(Words([r[1]], plain=True).hash)]
        if rows:
            yield items.sparkSession.sparkContext.broadcast(build(rows, total.n, df, mean, percent, least))


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that contain test items: ``doc_id, item_id, question_shared, question_size, answer_shared, answer_size``.

    Every passage of every whole text, and the text itself, queries the BM25 index of the items (lower case, words parted
    by white space and ASCII punctuation); items that score ``least`` of their own score or more are
    retrieved, without a limit, and those of which a leak may score less, from that score on. A pair is a leak if the document has ``percent`` % of the distinct
    five-word runs of the item's question and of its answer (the last quarter; an item of fewer than
    ten words has an answer only, one of fewer than five counts as one run).

    Null and empty texts and items have no leaks; rows that repeat give repeated rows; null ids stay
    null; an empty table of either kind gives an empty table. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, question_shared bigint, question_size bigint, answer_shared bigint, answer_size bigint"
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for sent in indexes(items, percent, least):  # one pass for each index

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                for a, _, texts in text_slices(batch.column(1), 250_000):
                    out = [(a + text, index.item_ids[item], *sizes) for text, item, *sizes in leaking(index, Words(texts, plain=True), percent, least)]
                    cols = list(zip(*out, strict=True)) if out else [[]] * 6
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64())] + [pa.array(c, pa.int64()) for c in cols[2:]],
                        names=["doc_id", "item_id", "question_shared", "question_size", "answer_shared", "answer_size"],
                    )

        found = found.union(known.mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, least: float = 0.6, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no test item as ``leaks`` finds them; a pass for each index, no shuffle."""
    at = docs.columns.index(text_col)
    for sent in indexes(items, percent, least):

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                for a, b, texts in text_slices(batch.column(at), 250_000):
                    keep = np.ones(b - a, bool)
                    keep[[x[0] for x in leaking(index, Words(texts, plain=True), percent, least)]] = False
                    yield batch.slice(a, b - a).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Leaks of the benchmark into all documents."""
    from tidemark.tables import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by plain SQL, without the search: every pair that shares a word run.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D!-/:-@\[-`{-~]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D!-/:-@\[-`{-~]+') AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT *, len(w) AS n, least(5, len(w)) AS k, CASE WHEN len(w) - greatest(5, len(w) // 4) >= 5 THEN len(w) - greatest(5, len(w) // 4) ELSE 0 END AS cut FROM b WHERE len(w) > 0),
runs AS (
  SELECT DISTINCT item, item_id, k, 'q' AS part, array_to_string(w[i:i + k - 1], ' ') AS g FROM c, generate_series(1, 10000) AS s(i) WHERE i + k - 1 <= cut
  UNION ALL
  SELECT DISTINCT item, item_id, k, 'a', array_to_string(w[i:i + k - 1], ' ') FROM c, generate_series(1, 10000) AS s(i) WHERE i > cut AND i + k - 1 <= n),
sizes AS (SELECT item, item_id, count(*) FILTER (part = 'q') AS qs, count(*) FILTER (part = 'a') AS rs FROM runs GROUP BY ALL),
own AS (SELECT DISTINCT row, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT row, doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM c) WHERE len(w) >= k)),
shared AS (SELECT row, doc_id, item, count(*) FILTER (part = 'q') AS q, count(*) FILTER (part = 'a') AS r FROM own JOIN runs USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, q AS question_shared, qs AS question_size, r AS answer_shared, rs AS answer_size
FROM shared JOIN sizes USING (item) WHERE 100 * q >= 80 * qs AND 100 * r >= 80 * rs
"""
