"""A stored inverted index: segments of posting blocks by term range, delete marks, merges, and top k without reading blocks that cannot matter.

What a search without an index does (``plans.search``) costs a pass over all texts; here a query reads the blocks of its terms only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.search import B, K1, EmptyQuery, tokens
from tidemark.sources.snapshots import Versions
from tidemark.tables import small_batches

#: Postings of a block; ids of a range (as a power of two) that a block stays within, which bounds what a task gathers of one term.
BLOCK, RANGE = 128, 17
#: Sets of ids are sent to every executor as bits while they have at most so many ranges (16 KB each); else postings are joined to them.
BIT_RANGES = 2048
#: Ids of a cell (as a power of two), in which bounds of several terms are added up.
CELL = 10
#: Tokens that become arrays at once.
SLICE = 1 << 19
#: The term that every item has once; its postings are the list of items, with their lengths.
ITEM = ""
_FRAGMENT = "term string, key bigint, range bigint, off array<int>, tf array<int>, len array<int>, places array<int>"
_BLOCKS = "term string, range bigint, first bigint, last bigint, n int, off array<int>, tf array<int>, len array<int>, places array<int>, max_tf int, min_ratio double, shard int"


def term_key(term: str) -> int:
    """The first six bytes of a term as a number, in the terms' own order."""
    return int.from_bytes(term.encode()[:6].ljust(6, b"\0"), "big")


def _key_column(term: Column) -> Column:
    return F.conv(F.rpad(F.hex(F.substring(term.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("bigint")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ``sizes`` values from each of ``starts`` on, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values.astype(np.int32)))


def _fragments(columns: int):
    """Items ``(id, tokens of each column)`` to one row for each term and range of ids of a slice, postings by id."""

    def made(ids: np.ndarray, lists: list[pa.Array]) -> pa.RecordBatch:
        n = len(ids)
        counts = [np.diff(x.offsets.to_numpy()) for x in lists]
        doc = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
        code = np.concatenate([_ragged(np.zeros(n, np.int64), c) * columns + k for k, c in enumerate(counts)])
        length = np.sum(counts, axis=0)
        words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode() if length.any() else pa.array([], pa.string()).dictionary_encode()
        has = np.flatnonzero(length)  # an item without a token is none of the index's
        term = np.concatenate([words.indices.to_numpy(zero_copy_only=False), np.full(len(has), len(words.dictionary))]).astype(np.int64)
        doc, code = np.concatenate([doc, has]), np.concatenate([code, np.full(len(has), -1)])
        order = np.lexsort((code, ids[doc], term))
        term, doc, code = term[order], doc[order], code[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(term)))
        term, doc = term[at], doc[at]
        span = ids[doc] >> RANGE
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (span[1:] != span[:-1])
        rows = np.flatnonzero(head)
        sizes = np.diff(np.append(rows, len(term)))
        listed = code >= 0
        held = np.add.reduceat(np.where(term == len(words.dictionary), 0, tf), rows) if len(rows) else sizes
        names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([ITEM])])
        keys = np.array([term_key(t) for t in names.to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(term[rows])), pa.array(keys[term[rows]]), pa.array(span[rows]), _lists(ids[doc] - (span << RANGE), sizes), _lists(tf, sizes), _lists(length[doc], sizes), _lists(code[listed], held)],
            names=["term", "key", "range", "off", "tf", "len", "places"],
        )

    def run(batches):
        for batch in batches:
            sizes = sum(pc.list_value_length(batch.column(1 + k)).to_numpy(zero_copy_only=False) for k in range(columns))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            a, total = 0, np.cumsum(sizes)
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE)))
                parts = [batch.column(1 + k).slice(a, b - a) for k in range(columns)]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(p).to_numpy(zero_copy_only=False))]).astype(np.int32)), p.flatten()) for p in parts]
                yield made(ids[a:b], lists)
                a = b

    return run


def _bit(item_id: Column) -> Column:
    """Whether the id is in ``_bits`` of its range; null where there are none."""
    word = F.get("_bits", F.shiftright(item_id, 6).bitwiseAND(F.lit((1 << (RANGE - 6)) - 1)).cast("int"))
    return F.call_function("shiftright", word, item_id.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _living(batches):
    """Blocks with ``head``, their first id in its range, and ``alive`` of each posting (null: all) to fragments."""
    for batch in batches:
        flat = lambda name: batch[name].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(batch["off"]).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        keep = np.ones(len(row), bool)
        keep[pc.is_valid(batch["alive"]).to_numpy(zero_copy_only=False)[row]] = batch["alive"].flatten().to_numpy(zero_copy_only=False)
        off, tf, length, row_places = flat("off") + batch["head"].to_numpy()[row], flat("tf"), flat("len"), pc.list_value_length(batch["places"]).to_numpy(zero_copy_only=False)
        held = np.where(row_places[row] > 0, tf, 0)  # the list of items has no places
        n, places = np.bincount(row[keep], minlength=len(sizes)), flat("places")[np.repeat(keep, held)]
        some = np.flatnonzero(n)
        kept = np.bincount(row[keep], held[keep], len(sizes)).astype(np.int64)
        terms = batch["term"].take(pa.array(some))
        yield pa.RecordBatch.from_arrays(
            [terms, pa.array(np.array([term_key(t) for t in terms.to_pylist()], np.int64)), batch["range"].take(pa.array(some)), _lists(off[keep], n[some]), _lists(tf[keep], n[some]), _lists(length[keep], n[some]), _lists(places, kept[some])],
            names=[f.split()[0] for f in _FRAGMENT.split(", ")],
        )


def _blocks(batches):
    """Fragments sorted by term and range to blocks of at most ``BLOCK`` postings, by id."""

    def made(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        flat = lambda name: pc.list_flatten(t[name]).to_numpy().astype(np.int64)
        sizes = pc.list_value_length(t["off"]).to_numpy().astype(np.int64)
        names, spans = t["term"].combine_chunks().dictionary_encode(), t["range"].to_numpy()
        off, tf, length, places = flat("off"), flat("tf"), flat("len"), flat("places")
        row = np.repeat(np.arange(len(sizes)), sizes)
        term, span = names.indices.to_numpy()[row].astype(np.int64), spans[row]
        held = np.where(np.repeat(np.array([not x for x in t["term"].to_pylist()]), sizes), 0, tf)
        begins = np.cumsum(held) - held
        # rows come in the order of terms: only within a term and range do fragments need to be merged
        key = np.cumsum(np.concatenate([[False], (term[1:] != term[:-1]) | (span[1:] != span[:-1])])) if len(term) else term
        order = np.lexsort((off, key))
        key, off, tf, length, held, begins, row = (x[order] for x in (key, off, tf, length, held, begins, row))
        firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - firsts[key] if len(key) else key
        at = np.flatnonzero(rank % BLOCK == 0)
        n = np.diff(np.append(at, len(key)))
        last = at + n - 1
        base = spans[row[at]] << RANGE
        places = places[_ragged(begins, held)]
        return pa.RecordBatch.from_arrays(
            [
                t["term"].combine_chunks().take(pa.array(row[at])), pa.array(spans[row[at]]), pa.array(base + off[at]), pa.array(base + off[last]), pa.array(n.astype(np.int32)), _lists(off - np.repeat(off[at], n), n),
                _lists(tf, n), _lists(length, n), _lists(places, np.add.reduceat(held, at) if len(at) else n), pa.array((np.maximum.reduceat(tf, at) if len(at) else n).astype(np.int32)),
                pa.array(np.minimum.reduceat(length / tf, at) if len(at) else np.zeros(0)), t["shard"].combine_chunks().take(pa.array(row[at])),
            ],
            names=[f.split()[0] for f in _BLOCKS.split(", ")],
        )

    carried: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if carried is None else pa.concat_tables([carried, t])
        if not t.num_rows:
            continue
        end = (t["term"][-1].as_py(), t["range"][-1].as_py())
        same = pc.and_(pc.equal(t["term"], end[0]), pc.equal(t["range"], end[1])).to_numpy()
        cut = int(np.argmax(same))  # sorted: the rows of the last term and range are one run at the end
        if cut:
            yield made(t.slice(0, cut))
        carried = t.slice(cut)
    if carried is not None:
        yield made(carried)


class StoredIndex:
    """The index under ``path`` of the given columns of items ``(id, ...)``; every change is a new version, so readers see one state.

    A segment holds blocks ``(shard, term, first, last, n, off, tf, len, places, max_tf, min_ratio)``: ids as offsets to the first, the term's count in and the length of each item, and
    the term's places in it. Shards are folders by ranges of terms; within one, files are sorted by term. ``max_tf`` and ``min_ratio``, the least of length / count, bound the scores of a block.
    A delete writes marks, the ids and for each term how many items it lost, so statistics are exact at once. ``optimize`` merges segments and drops what is marked.

    Ids are unique, as a primary key is; items without an id are left out, and so are items that the index has already.
    """

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = ("title", "author", "content_text"), shards: int = 16):
        self.spark, self.path, self.columns, self.shards, self.versions = spark, path, columns, shards, Versions(spark, path)

    # --- writes

    def _tokenized(self, items: DataFrame) -> DataFrame:
        small_batches(self.spark)
        lists = [tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{k}") for k, c in enumerate(self.columns)]
        return items.where("id is not null").select(F.col("id").cast("bigint").alias("id"), *lists).mapInArrow(_fragments(len(self.columns)), _FRAGMENT)

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _segment(self, fragments: DataFrame, bounds: list[int]) -> dict:
        small_batches(self.spark)
        name = self.versions.fresh("segment")
        shard = reduce(lambda x, y: x + y, ((F.col("key") >= b).cast("int") for b in bounds), F.lit(0))
        dealt = fragments.withColumn("shard", shard).drop("key").repartition("shard", "range").sortWithinPartitions("shard", "term", "range")
        blocks = dealt.mapInArrow(_blocks, _BLOCKS)
        blocks.write.option("compression", "zstd").option("parquet.page.size", 1 << 16).partitionBy("shard").parquet(f"{self.path}/{name}")
        return {"name": name, "kind": "segment"} | self._totals(self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/{name}"))

    def _totals(self, blocks: DataFrame) -> dict:
        total = F.aggregate("len", F.lit(0).cast("bigint"), lambda x, y: x + y)
        got = blocks.where((F.col("shard") == 0) & (F.col("term") == ITEM)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(total), F.lit(0)).alias("tokens")).first()
        return got.asDict()

    def _bounds(self, fragments: DataFrame) -> list[int]:
        steps = [k / self.shards for k in range(1, self.shards)]
        got = fragments.where(F.col("term") != ITEM).agg(F.percentile_approx("key", F.lit(steps), F.lit(1000)).alias("b")).first().b if steps else None
        return sorted(set(got or []))

    def insert(self, items: DataFrame) -> int:
        """Adds items that the index lacks, as a segment of its own; returns the new version."""
        base, parts = self.versions.current()
        segments = [p for p in parts if p["kind"] == "segment"]
        if segments:
            bounds = segments[0]["bounds"]
            made = self._segment(self._tokenized(self._held(items, False)), bounds)
        else:
            scratch = self.versions.fresh("scratch")
            fragments = self._write(scratch, self._tokenized(items))
            bounds = self._bounds(fragments)
            made = self._segment(fragments, bounds)
            self._drop(scratch)
        made |= {"bounds": bounds, "at": base + 1}
        return self.versions.commit(base, [*parts, made])

    def delete(self, items: DataFrame) -> int:
        """Marks items as deleted; those that the index does not have are ignored. ``items`` carry the texts they were inserted with, as the terms' counts need them."""
        base, parts = self.versions.current()
        there = self._held(items, True)
        name = self.versions.fresh("marks")
        scratch = self.versions.fresh("scratch")
        lost = self._write(scratch, self._tokenized(there))
        lost.groupBy("term").agg(F.sum(F.size("off")).alias("n"), F.sum(F.aggregate("len", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("tokens")).write.parquet(f"{self.path}/{name}/terms")
        lost.where(F.col("term") == ITEM).select(F.explode(F.transform("off", lambda o: o + F.shiftleft("range", RANGE))).alias("item_id")).write.parquet(f"{self.path}/{name}/ids")
        self._drop(scratch)
        ranges = self.spark.read.schema("item_id bigint").parquet(f"{self.path}/{name}/ids").select(F.shiftright("item_id", RANGE)).distinct().count()
        total = self.spark.read.schema("term string, n bigint, tokens bigint").parquet(f"{self.path}/{name}/terms").where(F.col("term") == ITEM).first()
        return self.versions.commit(base, [*parts, {"name": name, "kind": "marks", "at": base + 1, "items": total.n if total else 0, "tokens": total.tokens if total else 0, "ranges": ranges}])

    def _bits(self, ids: DataFrame, *by: str) -> DataFrame:
        """``ids(item_id, *by)`` as ``_range, *by, _bits``, a bit for each id of a range, in words of 64."""
        span = F.shiftright("item_id", RANGE).alias("_range")
        off = F.col("item_id").bitwiseAND(F.lit((1 << RANGE) - 1)).cast("int")
        words = ids.select(span, *by, F.shiftright(off, 6).alias("word"), off.bitwiseAND(F.lit(63)).alias("bit")).groupBy("_range", *by, "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        held = words.groupBy("_range", *by).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # 2^11 words at most
        return held.select("_range", *by, F.transform(F.sequence(F.lit(0), F.lit((1 << (RANGE - 6)) - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint"))).alias("_bits"))

    def _held(self, items: DataFrame, there: bool) -> DataFrame:
        """Items that the index has, or those that it lacks; their texts are not shuffled while ids lie in ``BIT_RANGES`` ranges at most."""
        known = self._within(items)
        if known is None:
            return items.limit(0) if there else items
        if known.select(F.shiftright("id", RANGE)).distinct().limit(BIT_RANGES + 1).count() > BIT_RANGES:
            return items.join(known, "id", "left_semi" if there else "left_anti")
        bits, wide = self._bits(known.select(F.col("id").alias("item_id"))), F.col("id").cast("bigint")
        marked = items.withColumn("_range", F.shiftright(wide, RANGE)).join(F.broadcast(bits), "_range", "left")
        return marked.where(F.coalesce(_bit(wide), F.lit(False)) == there).select(*(F.col(f"`{c}`") for c in items.columns))

    def optimize(self) -> int:
        """Merges all segments into one without what is marked; texts are not read again. Shards follow the terms anew."""
        base, _ = self.versions.current()
        blocks = self._read()
        bounds = self._bounds(blocks.select("term", _key_column(F.col("term")).alias("key")))
        if self._many_dead():
            scratch = self.versions.fresh("scratch")
            alive = self._alive(self._decoded(blocks))
            span = F.shiftright("item_id", RANGE)
            posting = F.struct((F.col("item_id") - F.shiftleft(span, RANGE)).cast("int").alias("off"), "tf", "len", "places")
            rows = alive.groupBy("term", span.alias("range"), F.shiftright("item_id", 7).alias("_few")).agg(F.array_sort(F.collect_list(posting)).alias("p"))  # 128 at most
            fragments = self._write(scratch, rows.select("term", _key_column(F.col("term")).alias("key"), "range", F.col("p.off").alias("off"), F.col("p.tf").alias("tf"), F.col("p.len").alias("len"), F.flatten("p.places").alias("places")))
            made = self._segment(fragments, bounds)
            self._drop(scratch)
        else:
            # blocks lose what is marked where they lie and are fragments then
            small_batches(self.spark)
            head = (F.col("first") - F.shiftleft("range", RANGE)).cast("int")
            alive = F.when(F.col("_bits").isNotNull(), F.transform("off", lambda o: ~_bit((head + o).cast("bigint"))))
            marked = blocks.join(F.broadcast(self._dead()), (F.col("range") == F.col("_range")) & (F.col("at") == F.col("_at")), "left")
            made = self._segment(marked.select("term", "range", head.alias("head"), "off", "tf", "len", "places", alive.alias("alive")).mapInArrow(_living, _FRAGMENT), bounds)
        made |= {"bounds": bounds, "at": base + 1}
        return self.versions.commit(base, [made])

    def _within(self, items: DataFrame) -> DataFrame | None:
        """The ``id`` of the index's items in the range of those of ``items``; None if no block lies in it, as for ids that go on from the greatest."""
        ends = items.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        blocks = self._read([ITEM]).where((F.col("last") >= F.lit(ends.lo)) & (F.col("first") <= F.lit(ends.hi)))
        return None if blocks.isEmpty() else self._alive(self._counted(blocks)).select(F.col("item_id").alias("id"))

    def _drop(self, name: str) -> None:
        where, fs = self.versions._at(f"{self.path}/{name}")
        fs.delete(where, True)

    # --- reads

    def _read(self, terms: Iterable[str] | None = None, prefix: str | None = None) -> DataFrame:
        """Blocks of all segments, with ``at``, the version that wrote them; of given terms or a prefix only their shards are read."""
        out = []
        for p in self.versions.current()[1]:
            if p["kind"] != "segment":
                continue
            rows = self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/{p['name']}").withColumn("at", F.lit(p["at"]))
            if terms is not None:
                rows = rows.where(F.col("shard").isin(sorted({bisect_right(p["bounds"], term_key(t)) for t in terms})) & F.col("term").isin(list(terms)))
            elif prefix is not None:
                ends = bisect_right(p["bounds"], term_key(prefix)), bisect_right(p["bounds"], int.from_bytes(prefix.encode()[:6].ljust(6, b"\xff"), "big"))
                rows = rows.where(F.col("shard").between(*ends) & F.col("term").startswith(prefix))
            out.append(rows)
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], f"{_BLOCKS}, at int")

    def _marks(self, what: str, schema: str) -> DataFrame:
        marks = [p for p in self.versions.current()[1] if p["kind"] == "marks"]
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{p['name']}/{what}").withColumn("dead", F.lit(p["at"])) for p in marks]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], f"{schema}, dead int")

    def _alive(self, postings: DataFrame) -> DataFrame:
        """Postings ``(item_id, at, ...)`` of which no later version marks the item."""
        if not any(p["kind"] == "marks" for p in self.versions.current()[1]):
            return postings
        if not self._many_dead():
            marked = postings.withColumn("_range", F.shiftright("item_id", RANGE)).join(F.broadcast(self._dead().withColumnRenamed("_at", "at")), ["_range", "at"], "left")
            return marked.where(~F.coalesce(_bit(F.col("item_id")), F.lit(False))).drop("_range", "_bits")
        dead = self._marks("ids", "item_id bigint").groupBy("item_id").agg(F.max("dead").alias("dead"))
        return postings.join(dead, "item_id", "left").where("dead is null or dead < at").drop("dead")

    def _many_dead(self) -> bool:
        """Whether marks lie in more ranges than are sent to every executor."""
        parts = self.versions.current()[1]
        return sum(p.get("ranges", BIT_RANGES + 1) for p in parts if p["kind"] == "marks") * max(1, sum(p["kind"] == "segment" for p in parts)) > BIT_RANGES

    def _dead(self) -> DataFrame:
        """``_range, _at, _bits``: the ids that are marked in segments of a version."""
        ats = F.array(*(F.lit(p["at"]) for p in self.versions.current()[1] if p["kind"] == "segment")).cast("array<int>")
        return self._bits(self._marks("ids", "item_id bigint").withColumn("_at", F.explode(ats)).where("dead >= _at").select("item_id", "_at"), "_at")

    def _decoded(self, blocks: DataFrame) -> DataFrame:
        """``item_id, term, tf, len, places, at``: a row for each posting."""
        starts = F.aggregate("tf", F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a")), lambda x, t: F.struct((x["s"] + t).alias("s"), F.concat(x["a"], F.array(x["s"])).alias("a")), lambda x: x["a"])
        none = F.col("term") == ITEM
        own = F.transform(F.arrays_zip("off", "tf", "len", F.when(none, F.transform("tf", lambda t: F.lit(0))).otherwise(starts).alias("begin")), lambda p: F.struct(
            p["off"].alias("off"), p["tf"].alias("tf"), p["len"].alias("len"), F.when(none, F.array().cast("array<int>")).otherwise(F.slice("places", p["begin"] + 1, p["tf"])).alias("places")))
        return blocks.select("term", "first", "at", F.explode(own).alias("p")).select((F.col("first") + F.col("p.off")).alias("item_id"), "term", "p.tf", "p.len", "p.places", "at")

    def _counted(self, blocks: DataFrame) -> DataFrame:
        """``item_id, term, tf, len, at``, without reading the places."""
        return blocks.select("term", "first", "at", F.explode(F.arrays_zip("off", "tf", "len")).alias("p")).select((F.col("first") + F.col("p.off")).alias("item_id"), "term", "p.tf", "p.len", "at")

    def items(self) -> DataFrame:
        """``item_id, len`` of every item of the index."""
        return self._alive(self._counted(self._read([ITEM]))).select("item_id", "len")

    def counts(self, terms: list[str] | None = None) -> DataFrame:
        """``item_id, term, tf`` of the given terms, or of all."""
        return self._alive(self._counted(self._read(terms).where(F.col("term") != ITEM))).select("item_id", "term", F.col("tf").cast("bigint").alias("tf"))

    def postings(self, terms: list[str] | None = None, prefix: str | None = None) -> DataFrame:
        """``item_id, column, place, term`` of the given terms, of a prefix, or of all, for the matches of ``plans.search``."""
        names = F.array(*(F.lit(c) for c in self.columns))
        rows = self._alive(self._decoded(self._read(terms, prefix).where(F.col("term") != ITEM))).select("item_id", "term", F.explode("places").alias("code"))
        return rows.select("item_id", F.element_at(names, F.col("code") % len(self.columns) + 1).alias("column"), F.floor(F.col("code") / len(self.columns)).cast("int").alias("place"), "term")

    # --- rank

    def _weights(self, terms: list[str], headers: DataFrame) -> tuple[dict[str, float], float]:
        """The weight of each term and the mean length, over what is alive: counts of segments less those of marks."""
        parts = self.versions.current()[1]
        sign = {"segment": 1, "marks": -1}
        n, total = (sum(sign[p["kind"]] * p[c] for p in parts) for c in ("items", "tokens"))
        df = {r.term: r.n for r in headers.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term of the query
        for r in self._marks("terms", "term string, n bigint").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r.term] = df.get(r.term, 0) - r.n
        raw = {t: np.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items() if d > 0}
        return {t: float(x) if x > 0 else 1e-6 for t, x in raw.items()}, total / n if n else 0.0

    def _scored(self, blocks: DataFrame, weights: dict[str, float], mean: float) -> DataFrame:
        """``item_id, gain``: the terms' weighted counts of the postings in ``blocks``."""
        weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("term"))
        gain = weight * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean))))
        return self._alive(self._counted(blocks)).groupBy("item_id").agg(F.sum(gain).alias("gain"))

    def needed(self, terms: list[str], k: int, seeds: int = 8) -> tuple[DataFrame, DataFrame, dict[str, float], float]:
        """All blocks of the terms and those of them that the best ``k`` may be in, with the weights and the mean length.

        First, the blocks of highest bound are scored in full; the k-th best of their items is a threshold that the k-th best of all reaches. Then the
        bounds of every term are added up in cells of ids, from the blocks' heads alone: a block is needed if in one of its cells its own bound and the best of the
        other terms reach the threshold. An item that reaches it has all of its blocks among these, so its score is whole.
        """
        blocks = self._read(terms)
        heads = blocks.select("term", "at", "first", "last", "n", "max_tf", "min_ratio")
        weights, mean = self._weights(terms, heads)
        if not weights:
            return blocks, blocks.limit(0), weights, mean
        weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("term"))
        heads = heads.where(F.col("term").isin(list(weights))).withColumn("bound", weight * (K1 + 1) / (1 + K1 * ((1 - B) / F.col("max_tf") + B * F.col("min_ratio") / F.lit(mean))) * (1 + 1e-9))
        best = heads.orderBy(F.desc("bound"), "term", "at", "first").limit(max(seeds, 2 * k // BLOCK)).collect()  # bounded by k
        spans = reduce(lambda x, y: x | y, ((F.col("first") <= r["last"]) & (F.col("last") >= r["first"]) for r in best))
        inside = reduce(lambda x, y: x | y, (F.col("item_id").between(r["first"], r["last"]) for r in best))
        tops = self._scored(blocks.where(spans), weights, mean).where(inside).orderBy(F.desc("gain")).limit(k).collect()
        least = tops[-1].gain * (1 - 1e-9) if len(tops) == k else 0.0
        cells = heads.withColumn("cell", F.explode(F.sequence(F.shiftright("first", CELL), F.shiftright("last", CELL))))
        per = cells.groupBy("cell", "term").agg(F.max("bound").alias("most"))
        sums = per.groupBy("cell").agg(F.sum("most").alias("total"))
        reach = cells.join(per, ["cell", "term"]).join(sums, "cell").where(F.col("bound") + F.col("total") - F.col("most") >= least)
        keys = reach.select("term", "at", "first").distinct()
        return blocks, blocks.join(keys, ["term", "at", "first"], "left_semi"), weights, mean

    def top(self, terms: list[str], k: int = 50) -> DataFrame:
        """``item_id, score`` of the best ``k`` items (1 to 500) for any of the terms, as ``search.bm25`` scores them; ties by id."""
        terms = list(dict.fromkeys(t for t in terms if t))
        if not terms:
            raise EmptyQuery
        if not 1 <= k <= 500:
            raise ValueError("k must be from 1 to 500")
        _, needed, weights, mean = self.needed(terms, k)
        if not weights:
            return self.spark.createDataFrame([], "item_id bigint, score double")
        return self._scored(needed, weights, mean).select("item_id", (-F.col("gain")).alias("score")).orderBy("score", "item_id").limit(k)
