"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.words import text_slices

#: Texts are parsed side by side in runs of so many characters; a phrase that would cross from one to the next counts twice.
LANE = 1024
PAD = 1
#: Characters that are parsed at once.
SLICE = 1_000_000


def training_texts(docs: DataFrame, rows_per_lang: int = 48, chars_per_row: int = 400) -> list[tuple[str, str]]:
    """A bounded sample of labelled text: ``(lang, text)`` per language, sorted by language.

    Of the rows whose ``lang`` and ``text`` are not null and whose crc32 of the id as text is not 2
    modulo 4, each language's ``rows_per_lang`` distinct texts of least hash are taken, and of each
    the first ``chars_per_row`` letters. What reaches the driver is bounded by these two parameters
    and the number of languages.
    """
    from pyspark.sql import Window

    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
        & (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) != 2)
    ).select("lang", F.xxhash64("text").alias("h"), "text")
    pool = cut(labelled.select("lang", "h").distinct())
    # hashes are even over 64 bits: below this one of them a language has many more than it needs, but no task sees more than those
    sizes = pool.groupBy("lang").agg(F.count("*").alias("n"))
    top = F.when(F.col("n") <= 8 * rows_per_lang, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * 8 * rows_per_lang / F.col("n")).cast("bigint"))
    least = pool.join(F.broadcast(sizes.select("lang", top.alias("top"))), "lang").where("h <= top")
    order = Window.partitionBy("lang").orderBy("h")
    picked = least.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows_per_lang).select("lang", "h").collect()
    if not picked:
        return []
    chosen = {(r.lang, r.h) for r in picked}
    rows = (
        labelled.where(F.col("h").isin([r.h for r in picked]))
        .select("lang", "h", F.substring("text", 1, 4 * chars_per_row).alias("text"))
        .dropDuplicates(["lang", "h"]).collect()
    )
    out: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        if (r.lang, r.h) in chosen:
            out.setdefault(r.lang, []).append((r.h, r.text))
    return [(lang, " ".join(fold(t)[:chars_per_row] for _, t in sorted(out[lang]))) for lang in sorted(out)]


def fold(text: str) -> str:
    """Lower case; every run of characters that are not letters becomes one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(codes: list[int], width: int) -> np.ndarray:
    """The suffix automaton of ``codes`` as a dense table, one row per state (-1: no such substring)."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.full((len(nxt), width), -1, np.int32)
    for s, row in enumerate(nxt):
        for c, t in row.items():
            table[s, c] = t
    return table


def parser(table: np.ndarray) -> np.ndarray:
    """The automaton as a machine that counts phrases.

    An entry is ``2 * (next state * width) + 1 if a new phrase begins here``. A phrase is the longest
    match from where it begins; a character that the training text lacks is a phrase of its own.
    """
    fresh = np.maximum(table[0], 0)
    new = table < 0
    new[0, :] = True
    out = np.where(table >= 0, table, fresh[None, :])
    out *= 2 * table.shape[1]
    out += new
    out[:, PAD] = 0
    return out.ravel()


def machines(trained: tuple[tuple[str, str], ...]):
    """Code points to codes (0: no letter, 1: padding, 2: a letter that training lacks), and a parser per language."""
    known = sorted({c for _, t in trained for c in t if c != " "})
    code = np.zeros(0x110000, np.uint8 if len(known) < 250 else np.uint16)
    for i in range(0x110000):
        if chr(i).isalpha():
            code[i] = 2
    for i, c in enumerate(known):
        code[ord(c)] = 3 + i
    width = 3 + len(known)
    return code, width, [parser(automaton([0 if c == " " else int(code[ord(c)]) for c in t], width)) for _, t in trained]


def phrases(texts: list[str | None], made: tuple) -> tuple[np.ndarray, np.ndarray]:
    """With ``made`` by ``machines``, per text the number of characters that count, and per language the number of phrases.

    Texts are folded, parsed whole, and laid out in lanes of ``LANE`` characters that are worked on side by side; a phrase
    ends where its lane ends, for every language alike, which adds at most one phrase in ``LANE`` characters to a count.
    """
    code, width, tables = made
    lanes, owner, sizes = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        c = code[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)]
        if not c.any():
            continue
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        c = c[keep]
        sizes[i] = len(c)
        rows = -(-len(c) // LANE)
        padded = np.full(rows * LANE, PAD, c.dtype)
        padded[: len(c)] = c
        lanes.append(padded.reshape(rows, LANE))
        owner.append(np.full(rows, i))
    counts = np.zeros((len(texts), len(tables)), np.int64)
    if not lanes:
        return sizes, counts
    columns, at = np.ascontiguousarray(np.concatenate(lanes).T.astype(np.int32)), np.concatenate(owner)
    for k, table in enumerate(tables):
        state, found = np.zeros(columns.shape[1], np.int32), np.zeros(columns.shape[1], np.int32)
        for column in columns:
            got = table[state + column]
            found += got & 1
            state = got >> 1
        counts[:, k] = np.bincount(at, found, len(texts)).astype(np.int64)
    return sizes, counts


def weights_of(trained: tuple[tuple[str, str], ...]) -> np.ndarray:
    """What a phrase of each language counts: a match in a text of m characters is about log(m) / entropy long, so the
    phrases of a language that was trained on less count for less, by the ratio of logarithms."""
    logs = np.log2([2 + len(t) for _, t in trained])
    return logs / logs.max() if len(logs) else logs


def identify(docs: DataFrame, trained: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``id_col, lang_pred, score, phrase_rate``.

    ``phrase_rate`` is normalised phrases (``weights_of``) per folded character for the winning language (the cross-parsing
    estimate, smaller is closer); ``score`` is one minus its ratio to the second best, from 0 to 1.
    Ties go to the first language in code order. A null or empty text, one without letters, and
    every text when there is no training text, get ``und``, score 0 and no rate. Rows keep their
    multiplicity and null ids stay null; other columns are ignored. Very long texts are parsed
    whole.
    """
    langs, weights = [lang for lang, _ in trained], weights_of(tuple(trained))
    sent = docs.sparkSession.sparkContext.broadcast(machines(tuple(trained)))  # its size is bounded by the sample's

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for *a, part in text_slices(batch.column(1), SLICE):
                pred, score, rate = ["und"] * len(part), np.zeros(len(part)), [None] * len(part)
                if langs:
                    sizes, counts = phrases(part, sent.value)
                    counts = counts * weights
                    lettered = sizes > 0
                    best = counts.argmin(1)
                    ordered = np.sort(counts, 1)
                    second = ordered[:, 1] if counts.shape[1] > 1 else sizes
                    for i in np.flatnonzero(lettered):
                        pred[i] = langs[best[i]]
                        score[i] = max(0.0, 1 - ordered[i, 0] / max(1e-9, second[i]))
                        rate[i] = float(ordered[i, 0] / sizes[i])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a[0], a[1] - a[0]), pa.array(pred), pa.array(score), pa.array(rate, pa.float64())],
                    names=[id_col, "lang_pred", "score", "phrase_rate"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, phrase_rate double")


def keep_known(docs: DataFrame, trained: list[tuple[str, str]], most: float, allow: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has letters and at most ``most`` normalised phrases a folded character, and ``allow`` more.

    One pass without a shuffle. Null and empty texts go; so does every text when there is no training text.
    """
    at, weights = docs.columns.index(text_col), weights_of(tuple(trained))
    sent = docs.sparkSession.sparkContext.broadcast(machines(tuple(trained)))

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at), SLICE):
                keep = np.zeros(b - a, bool)
                if len(weights):
                    sizes, counts = phrases(texts, sent.value)
                    keep = (sizes > 0) & ((counts * weights).min(1) <= most * sizes + allow)
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language; see ``identify`` and ``training_texts``."""
    from tidemark.tables import table

    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    return identify(docs, training_texts(docs)).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "phrase_rate"
    )
