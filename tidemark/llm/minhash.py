"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, small
from tidemark.llm.words import Words, mix, shingles, text_slices

#: Permutations hashed, and bands of values; each permutation gives two values, so bands * rows = 2 * PERMUTATIONS.
PERMUTATIONS, BANDS, ROWS = 60, 24, 5
_RNG = np.random.default_rng(7)
_FLIP = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = mix(_RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64)) | np.uint64(1)
_CHUNK = 1 << 15
#: Bins of the screening sketch; each holds four bits of the least hash that falls into it.
BINS = 512


def min_max(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures of runs of shingle hashes: per permutation the least and the greatest value.

    A permutation is evaluated once and serves two signature values: two sets agree in either with
    a probability of their Jaccard similarity, and the two agreements are negatively correlated,
    so the estimate from as many values has less variance than from minima alone.
    """
    runs = len(first) - 1
    out = np.empty((runs, 2 * PERMUTATIONS), np.uint32)
    short = (value >> np.uint64(32)).astype(np.uint32)
    a = 0
    while a < runs:  # a few thousand shingles at a time stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(first, first[a] + _CHUNK, "right")) - 1)
        part, at = short[first[a] : first[b]], first[a:b] - first[a]
        for p in range(PERMUTATIONS):
            v = (part ^ _FLIP[p]) * _TIMES[p]
            v ^= v >> np.uint32(16)
            v *= np.uint32(0x45D9F3B)
            out[a:b, 2 * p] = np.minimum.reduceat(v, at)
            out[a:b, 2 * p + 1] = np.maximum.reduceat(v, at)
        a = b
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((mix(parts + np.uint64(1)) * _BAND[None]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))


def sketch(value: np.ndarray, of: np.ndarray, runs: int) -> np.ndarray:
    """One-permutation sketches of runs of ascending hashes: per bin 0 if empty, else 1 to 15; 16 bins a word."""
    code = np.zeros((runs, BINS), np.uint8)
    if len(value):
        at = of * BINS + (value >> np.uint64(55)).astype(np.int64)
        least = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        code.ravel()[at[least]] = 1 + (value[least] >> np.uint64(20)) % np.uint64(15)
    return (code[:, ::2] | code[:, 1::2] << 4).view(np.int64)


def _may_link(percent: int):
    """Whether sketches of sets x and y allow the similarity: the bins that differ are at most what
    is expected at the threshold and five standard deviations more."""
    part, miss = percent / 100, 1 - percent / 100
    union = (F.col("n") + F.col("n2")) / (1 + part)
    filled = F.lit(BINS) * (1 - F.exp(-union / BINS))
    spread = F.sqrt(F.lit(miss * part) * filled * (1.1 - filled / union))
    differ = " + ".join(f"bit_count((z{i} | shiftright(z{i}, 1) | shiftright(z{i}, 2) | shiftright(z{i}, 3)) & 1229782938247303441L)" for i in range(BINS // 16))
    for i in range(BINS // 16):
        differ = differ.replace(f"z{i} ", f"(sketch[{i}] ^ sketch2[{i}]) ").replace(f"z{i},", f"sketch[{i}] ^ sketch2[{i}],")
    return F.expr(differ) <= miss * filled + 5 * spread + 2


def _digest(value: np.ndarray) -> bytes:
    return hashlib.blake2b(value.tobytes(), digest_size=16).digest()


def _signed(batches):
    """Per document: id, mark of the text, set size, digest of the whole set, band keys, screening sketch."""
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column(2), 250_000):
            value, of = shingles(Words(texts))
            sizes = np.bincount(of, minlength=hi - lo)
            full = np.flatnonzero(sizes)
            first = np.concatenate([[0], np.cumsum(sizes[full])])
            keys = bands(min_max(value, first)).view(np.int64) if len(full) else np.zeros((0, BANDS), np.int64)
            digest: list[bytes | None] = [None] * (hi - lo)
            for i, a, b in zip(full, first[:-1], first[1:], strict=True):
                digest[i] = _digest(value[a:b])
            offsets = np.zeros(hi - lo + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), pa.array(sizes.astype(np.int64)), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (BINS // 16)), pa.array(sketch(value, of, hi - lo).ravel())),
                ],
                names=["doc_id", "mark", "n_shingles", "digest", "keys", "sketch"],
            )


def _sets(batches):
    """Texts to their sets: the set's digest and its sorted shingle hashes, as bytes."""
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column(0), 250_000):
            value, of = shingles(Words(texts))
            cuts = np.searchsorted(of, np.arange(hi - lo + 1))
            runs = [value[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(r) for r in runs], pa.binary()), pa.array([r.tobytes() for r in runs], pa.binary())], names=["digest", "shingles"])


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of distinct 5-word shingles are alike.

    Returns per row ``doc_id, n_shingles, component_id, kept``, and ``mark, first_mark``. Two documents are linked where
    100 * intersection >= ``percent`` * union; links are confirmed on full sets of 64-bit shingle
    hashes. ``component_id`` is the smallest id that links reach, and ``first_mark`` the smallest mark of a text with that id there
    (``mark``: a hash of the row's text).

    Documents with equal sets, told by the set's 128-bit digest, form one class. Classes that
    share a band key and whose sizes allow a link are candidates, in two rounds: first each with the
    one of its bucket that has the smallest id; then, only in buckets whose members are not yet all in one component,
    pairs of members from different components, each at the least key it shares and only where
    sketches of both sets allow a link. A link between members of one component cannot change the
    result, so no bucket is expanded into all its pairs. At the threshold a pair shares none of the
    24 bands of 5 values, or fails the sketch, with a probability of about 1e-6.

    Null and empty texts and texts without words have size 0 and are linked with nothing. Rows with
    a null id link like others, but give no component its id; their ``component_id`` is null where no id is reached, and they are not ``kept``. Rows that repeat
    an id are told apart by their texts, each with its own component. An empty table gives an empty table; other columns are ignored.
    """
    known = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    signed = cut(known.mapInArrow(_signed, "doc_id bigint, mark bigint, n_shingles bigint, digest binary, keys array<bigint>, sketch array<bigint>"))
    # of a class any member's text has the set; the one of least id and mark is fetched for it
    classes = cut(
        signed.where("n_shingles > 0").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    # A class that only meets itself needs no candidates: lone keys go before anything is joined.
    first_of = F.struct(F.col("at.doc_id").isNull().alias("none"), "at.doc_id", "at.mark", "rep", "n")
    keyed = classes.select("rep", "n", first_of.alias("place"), F.explode("keys").alias("key"))
    buckets = cut(
        keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("place").alias("hub"))
        .where("members > 1").join(keyed, "key").select("key", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    fits = lambda a, b: F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)
    star = cut(buckets.where((F.col("hub") != F.col("rep")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    first = cut(confirm(known, classes, star, percent))
    near = components(first).withColumnRenamed("node", "rep")
    placed = buckets.select("key", "rep", "n").join(near, "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = cut(placed.join(mixed, "key")).join(classes.select("rep", "keys", "sketch"), "rep")
    right = left.select("key", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "root", "keys", "sketch")))
    cross = (
        left.join(right, "key").where(
            (F.col("root") != F.col("root2")) & (F.col("rep") < F.col("rep2")) & fits(F.col("n"), F.col("n2")) & _may_link(percent)
            & (F.array_min(F.array_intersect("keys", "keys2")) == F.col("key"))
        ).select(F.col("rep").alias("a"), F.col("rep2").alias("b")).join(star, ["a", "b"], "left_anti")
    )
    links = first.union(confirm(known, classes, cut(cross), percent))
    roots = classes.select("digest", "rep").join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    # rows of a component meet under its root: one row for each class first, then the least id of all
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")
    own = signed.where("n_shingles > 0").groupBy("digest").agg(least).join(roots, "digest")
    named = own.select("digest", "root").join(own.groupBy("root").agg(F.min("least").alias("least")), "root").select("digest", "least")
    found = signed.select("doc_id", "mark", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "mark", F.coalesce("least.mark", "mark").alias("first_mark"),
    )
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "mark", "first_mark")


def without_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that stay when of each component of ``near_duplicates`` one row stays.

    It is the row of the smallest id, of rows with that id the one whose text has the least hash, and of rows equal in both any one. A component
    without any id keeps one of its rows, that of the least hash. Rows whose text is null or without words all stay.
    """
    near = cut(near_duplicates(docs, percent, id_col, text_col))
    key = [F.col(id_col).cast("bigint").alias("_tm_id"), F.xxhash64(text_col).alias("_tm_mark")]
    stay = near.where("n_shingles = 0 or (mark = first_mark and doc_id <=> component_id)").groupBy(F.col("doc_id").alias("_tm_id2"), F.col("mark").alias("_tm_mark2")).agg(
        F.count("*").alias("_tm_rows"), F.max("n_shingles").alias("_tm_size")
    )
    cols = docs.columns
    kept = docs.select("*", *key).join(stay, (F.col("_tm_mark") == F.col("_tm_mark2")) & F.col("_tm_id").eqNullSafe(F.col("_tm_id2")))
    repeated = F.col("_tm_size").cast("boolean") & (F.col("_tm_rows") > 1)
    if stay.where(repeated).isEmpty():
        return kept.select(cols)
    return kept.where(~repeated).select(cols).union(kept.where(repeated).dropDuplicates(["_tm_id", "_tm_mark"]).select(cols))


def confirm(known: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets are alike; the sets of one text of each class are made once."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(classes.select("rep", "digest", "at"), "rep")
    wanted = cut(wanted.select("rep", "digest", F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark")))
    sets = (
        known.join(small(wanted.select("_id", "_mark"), F.lit(2)), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi")
        .select("text").mapInArrow(_sets, "digest binary, shingles binary").dropDuplicates(["digest"])
    )
    sets = cut(sets.join(wanted.select("rep", "digest"), "digest").select("rep", "shingles"))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def alike(batches):
        for batch in batches:
            a, b, sa, sb = (batch.column(i) for i in range(4))
            ok = []
            for x, y in zip(sa, sb, strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                m = np.concatenate([p, q])
                m.sort()
                same = int((m[1:] == m[:-1]).sum())
                ok.append(100 * same >= percent * (len(m) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(alike, "a bigint, b bigint")


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, at 85 % of the union."""
    from tidemark.tables import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: The same by plain SQL: every pair that shares a shingle, and all that links reach.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(r.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of r ON r.a = d.doc_id
"""
