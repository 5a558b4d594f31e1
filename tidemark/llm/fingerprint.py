"""Exact fingerprints of canonical text, and of an edit of each document with its neighbour's words."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, id_bounds, partitions, small


def canonical(text: str) -> bytes:
    """NFKC, full case folding, NFKC again; every run of white space one space, none at the ends; as UTF-8."""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    """128-bit xxhash of the canonical bytes, in hexadecimal."""
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many, or all, of the first of ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def name(canon: bytes, hasher, shared: frozenset[str]) -> str:
    """The fingerprint: the digest; of a digest that different texts share, with their SHA-256 behind it."""
    fp = hasher(canon)
    return f"{fp}-{hashlib.sha256(canon).hexdigest()}" if fp in shared else fp


def _deal(bounds: list[int], lone: int, hasher, shared: frozenset[str]):
    """Rows dealt to id ranges. The highest row of a range also goes to the range above, as a
    ghost: it follows that range's last row. The highest of all goes to the lowest range, and to
    the ``lone`` parts (numbers below 0) over which rows without an id are spread."""

    def run(batches):
        edges, top = np.array(bounds, np.int64), len(bounds) - 1
        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                packed, fp = squeeze.compress(raw), name(canonical(text), hasher, shared)
                to = [(-1 - zlib.crc32(raw) % lone if doc_id is None else int(np.searchsorted(edges, doc_id)), False)]
                if doc_id is not None and bounds[to[0][0]] == doc_id:
                    to += [((to[0][0] + 1) if to[0][0] < top else 0, True)]
                    to += [(-1 - k, True) for k in range(lone)] * (to[0][0] == top)
                for part, ghost in to:
                    for column, v in zip(out, (part, ghost, doc_id, fp, packed), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
                names=["part", "ghost", "doc_id", "fp", "packed"],
            )

    return run


def _compare(hasher, shared: frozenset[str]):
    """Rows of a range in descending id order, its ghosts last: each row with the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(a, b):
        text = edited(a[1], b[1])
        canon = canonical(text)
        return a[0], len(a[1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), a[2], name(canon, hasher, shared), float(canon == a[3]), float(b[3] == a[3])

    def run(batches):
        open_up = zstandard.ZstdDecompressor()
        held, part, ghost = None, None, None
        for batch in batches:
            rows = []
            for p, g, doc_id, fp, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                text = open_up.decompress(packed).decode("utf-8", "surrogatepass")
                now = (doc_id, text, fp, canonical(text))
                if p != part:
                    part, held, ghost = p, None, None
                if p < 0:  # rows without an id: the ghost comes first and is what follows each of them
                    if g:
                        ghost = ghost or now
                    else:
                        rows.append(row(now, ghost or now))
                    continue
                if held is not None:
                    rows.append(row(held, now))
                held = None if g else now
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    return run


def _digests(hasher):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hasher(canonical(t or "")) for t in batch.column(0).to_pylist()], pa.string())], names=["fp"])

    return run


def _packed_canonical(hasher):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            canon = [canonical(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hasher(c) for c in canon], pa.string()), pa.array([squeeze.compress(c) for c in canon], pa.binary())], names=["fp", "packed"])

    return run


def shared_digests(docs: DataFrame, text_col: str = "text", hasher=digest) -> frozenset[str]:
    """Digests that different canonical texts share.

    Digests are counted first, and only texts of a digest that occurs twice or more are compared, byte by byte: the
    least and the greatest of each bucket, gathered by partial aggregates, so a large bucket is reduced before it is
    shuffled. Texts travel compressed by one compressor, which maps equal bytes to equal bytes and different ones to
    different ones. Of a 128-bit digest the answer is empty but for accidents, so it may reach the driver.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    several = cut(texts.mapInArrow(_digests(hasher), "fp string").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    packed = texts.mapInArrow(_packed_canonical(hasher), "fp string, packed binary").join(small(several, F.lit(4)), "fp", "left_semi")
    mixed = packed.groupBy("fp").agg(F.min("packed").alias("lo"), F.max("packed").alias("hi")).where("lo <> hi").select("fp")
    return frozenset(r.fp for r in mixed.collect())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, hasher=digest) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. A fingerprint is the 128-bit digest of the canonical text; where texts of one digest
    differ in their bytes (``shared_digests``), their fingerprints, those of edited texts too, have
    the SHA-256 of the canonical text behind the digest. Likeness is 1.0 where the canonical bytes
    are equal and else 0.0. Documents are dealt to ranges of the id and streamed in descending
    order; the one that follows the last of a range is dealt to it as well.

    A null text counts as empty. Rows with equal ids follow each other by fingerprint. A row without an id is
    followed by the first document, and follows none. A single document follows itself. An empty table gives
    an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = shared_digests(known, "text", hasher)
    bounds = id_bounds(known, "doc_id", parts or 2 * partitions(spark))
    lone = 0 if known.where("doc_id is null").isEmpty() else partitions(spark)
    dealt = known.mapInArrow(_deal(bounds, lone, hasher, shared), "part int, ghost boolean, doc_id bigint, fp string, packed binary")
    return (
        dealt.repartition(partitions(spark), "part")
        .sortWithinPartitions(F.col("part"), (F.col("ghost") != (F.col("part") < 0)), F.col("doc_id").desc(), "fp", "packed")
        .mapInArrow(_compare(hasher, shared), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprints."""
    from tidemark.tables import table

    return fingerprints(table(spark, sf_dir, "documents"))
