"""Token-id files: documents encoded, compressed by a Re-Pair grammar per shard, and read back."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_bounds, partitions, shared_dir
from tidemark.llm.words import Words

#: A pair becomes a rule if it occurs so often in a piece of a shard.
LEAST = 8
#: Symbols that are packed together, so that a reader need not unpack all.
CHUNK = 1 << 14
#: A worker forgets its words' ids when it holds so many.
REMEMBERED = 1_000_000


#: What ``encode_texts`` takes a tokenizer to do with a text before its merges.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def refuse_others(path: str) -> None:
    """Raises ``ValueError`` for a tokenizer that does other things with white space, case, letters or special strings than ``encode_texts`` relies on."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = (
        (told.get("normalizer") or {}).get("normalizers") == NORMALIZERS and splits[0].get("pattern") == {"Regex": SPLIT} and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
        and [(x.get("type"), x.get("use_regex"), x.get("add_prefix_space")) for x in splits[1:]] == [("ByteLevel", False, False)]
        and not any(told.get(k) for k in ("post_processor", "truncation", "padding")) and all(t["content"].startswith("<|") for t in told.get("added_tokens") or [])
    )
    if not known:
        raise ValueError(f"the tokenizer {path} is not supported")


class Vocabulary:
    """The ids of the words that a worker has met, by the words' hashes, as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hash, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def ids(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of ascending ``hashes``, in a row, and their numbers; ``word(i)`` is a new word's text."""
        new = np.flatnonzero(~np.isin(hashes, self.hash, assume_unique=True))
        if len(self.hash) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(hashes))
        runs, size = [self.flat], [self.size]
        for i in range(0, len(new), 10_000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([word(j) for j in new[i : i + 10_000]], add_special_tokens=False)]
            size.append(np.fromiter(map(len, got), np.int64, len(got)))
            runs.append(np.fromiter(chain.from_iterable(got), np.int32, int(size[-1].sum())))
        if len(new):
            every = np.concatenate([self.hash, hashes[new]])
            order = np.argsort(every, kind="stable")
            self.hash, self.size = every[order], np.concatenate(size)
            self.flat, _ = spread(np.concatenate(runs), self.size, order)
            self.size = self.size[order]
        at = np.searchsorted(self.hash, hashes)
        return spread(self.flat, self.size, at)[0], self.size[at]


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], path: str, end_id: int = 1) -> tuple[np.ndarray, tuple]:
    """Numbers of ids of the texts, each closed by ``end_id``, and what they are made of.

    The tokenizer drops white space, and parts letters from punctuation, before anything else, and
    takes A-Z as a-z, so a text's ids are those of its words in a row; each distinct word is encoded
    once. Second: the distinct words' ids in a row, each word's number of ids, the texts as one
    sequence of words (number 0 is the end), and each text's number of words. Texts with
    white space beyond ASCII's, or with the tokenizer's special strings, count as one word each.
    """
    odd = [i for i, t in enumerate(texts) if _special(t)]
    plain = list(texts)
    for i in odd:
        plain[i] = ""
    w = Words(plain, letters=True)
    hashes, at, code = np.unique(w.hash, return_index=True, return_inverse=True)
    vocabulary = _vocabulary(path)
    flat, size = vocabulary.ids(hashes, lambda i: w.word(at[i]).decode("utf-8", "surrogatepass"))
    whole = [vocabulary.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in odd]
    flat = np.concatenate([np.array([end_id], np.int32), flat, *(np.array(x, np.int32) for x in whole)])
    size = np.concatenate([[1], size, [len(x) for x in whole]]).astype(np.int64)
    counts, own = np.diff(w.first), np.zeros(len(texts), np.int64)
    own[odd] = 1
    total = counts + own + 1
    ends = np.cumsum(total) - 1
    sequence = np.zeros(int(total.sum()), np.int32)
    sequence[np.arange(len(code)) + np.repeat(np.cumsum(own + 1) - own - 1, counts)] = 1 + code
    sequence[ends[odd] - 1] = 1 + len(hashes) + np.arange(len(odd))
    lengths = np.add.reduceat(size[sequence], ends - total + 1) if len(texts) else np.zeros(0, np.int64)
    return lengths, (flat, size, sequence, total)


_ODD = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]|<\\|")


def _special(text: str) -> bool:
    return _ODD.search(text) is not None


def spread(flat: np.ndarray, size: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``sequence`` names, one after the other, and the length of each."""
    per = size[sequence]
    begin = (np.cumsum(size) - size)[sequence]
    shift = np.repeat(begin - (np.cumsum(per) - per), per)
    return flat[shift + np.arange(len(shift))], per


def repair(symbols: np.ndarray, run: np.ndarray, weight: np.ndarray, fresh: int, least: int = LEAST):
    """Re-Pair over runs of symbols until no pair occurs ``least`` times: ``symbols, run, rules``.

    ``run`` numbers the run a symbol belongs to (no pair crosses runs) and ``weight`` says how often
    each run occurs. In a round, pairs that occur ``least`` times are replaced by new symbols from ``fresh`` on,
    each position by the more frequent of the pairs it takes part in, all at once. A count only
    falls unless a new symbol takes part, so later rounds count the positions that were frequent and those beside a replacement.
    """
    far, n = np.iinfo(np.int64).max, len(symbols)
    symbols, rules, live = symbols.astype(np.int64), [np.zeros((0, 2), np.int64)], np.arange(max(0, n - 1))
    following, before, there, marked = np.arange(1, n + 1), np.arange(-1, n), np.ones(n, bool), np.zeros(n + 1, bool)
    while len(live):
        live = live[following[live] < n]
        live = live[run[live] == run[following[live]]]
        pair, times = symbols[live] << 32 | symbols[following[live]], weight[run[live]]
        if len(live) > 10_000:  # pairs whose hash alone is not frequent need not be sorted
            bucket = (pair * -7046029254386353131 >> 44) & 0xFFFFF
            live_too = np.bincount(bucket, times)[bucket] >= least
            live, pair, times = live[live_too], pair[live_too], times[live_too]
        kinds, inverse = np.unique(pair, return_inverse=True)
        count = np.bincount(inverse, times, len(kinds)).astype(np.int64)
        often = count[inverse] >= least
        live, inverse = live[often], inverse[often]
        if not len(live):
            break
        # a pair's rank: frequent first, then by its symbols; a position yields to neighbours of better rank
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((kinds, -count))] = np.arange(len(kinds))
        mine = rank[inverse]
        beside = live[1:] == following[live[:-1]]
        left, right = np.full(len(live), far), np.full(len(live), far)
        left[1:][beside], right[:-1][beside] = mine[:-1][beside], mine[1:][beside]
        # of a pair that overlaps itself, as in a run of one symbol, every other position
        begins = np.flatnonzero(left != mine)
        odd = (np.arange(len(live)) - np.repeat(begins, np.diff(np.append(begins, len(live))))) % 2 == 1
        take = (mine <= left) & (mine <= right) & ~odd
        chosen = live[take]
        used, new = np.unique(inverse[take], return_inverse=True)
        rules.append(np.stack([kinds[used] >> 32, kinds[used] & 0xFFFFFFFF], 1))
        symbols[chosen] = fresh + new
        fresh += len(used)
        gone = following[chosen]
        there[gone] = False
        following[chosen] = following[gone]
        before[following[chosen]] = chosen
        marked[:] = False
        marked[live[there[live]]] = marked[chosen] = marked[before[chosen]] = True  # the last place stands for what is before the first
        live = np.flatnonzero(marked[:n])
    return symbols[there], run[there], np.concatenate(rules)


def compress(parts: tuple, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A grammar of a shard: ``rules, symbols, per_text``.

    Pairs inside words are counted on the distinct words, weighted by how often each occurs, which
    gives the counts over the whole sequence; then pairs over the whole sequence within a document.
    """
    flat, size, sequence, total = parts
    often = np.bincount(sequence, minlength=len(size))
    flat, run, inner = repair(flat, np.repeat(np.arange(len(size)), size), often, terminals)
    symbols, per = spread(flat, np.bincount(run, minlength=len(size)), sequence)
    doc = np.repeat(np.repeat(np.arange(len(total)), total), per)
    symbols, doc, outer = repair(symbols, doc, np.ones(len(total), np.int64), terminals + len(inner))
    return np.concatenate([inner, outer]), symbols, np.bincount(doc, minlength=len(total))


def expansions(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol stands for: all expansions one after the other, and their lengths."""
    runs = [np.arange(terminals, dtype=np.int32)]
    size = [np.ones(terminals, np.int64)]
    a = 0
    while a < len(rules):  # rules of one round only name symbols of earlier ones
        level = np.maximum(rules[a:, 0], rules[a:, 1]) >= terminals + a
        b = a + int(level.argmax()) if level.any() else len(rules)
        text, per = spread(np.concatenate(runs), np.concatenate(size), rules[a:b].ravel())
        runs.append(text)
        size.append(per.reshape(-1, 2).sum(1))
        a = b
    return np.concatenate(runs), np.concatenate(size)


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, little-endian, byte planes apart, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def read_range(rules: bytes, symbols: list[bytes], symbol_counts: bytes, terminals: int, doc: int, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of the ``doc``-th document of a piece.

    Only the chunks with the document's symbols are unpacked; the rules' expansion lengths say which symbols cover
    the range, and only those are expanded, rule by rule, without what falls outside.
    """
    table, counts = unpack(rules).reshape(-1, 3), unpack(symbol_counts)
    first = int(counts[:doc].sum())
    last = first + int(counts[doc])
    a, b = first // CHUNK, -(-last // CHUNK)
    own = np.concatenate([unpack(c) for c in symbols[a:b]] or [np.zeros(0, np.int64)])[first - a * CHUNK : last - a * CHUNK]
    size_of = lambda x: np.where(x < terminals, 1, table[np.maximum(x - terminals, 0), 2] if len(table) else 1)
    size = size_of(own)
    at = np.cumsum(size) - size
    while True:
        inside = (at < hi) & (at + size > lo)
        own, at, size = own[inside], at[inside], size[inside]
        wide = np.flatnonzero(own >= terminals)
        if not len(wide):
            return own
        each = np.ones(len(own), np.int64)
        each[wide] = 2
        place = np.cumsum(each) - each
        out, start = np.repeat(own, each), np.repeat(at, each)
        pairs = table[own[wide] - terminals]
        out[place[wide]], out[place[wide] + 1] = pairs[:, 0], pairs[:, 1]
        start[place[wide] + 1] += size_of(pairs[:, 0])
        own, at, size = out, start, size_of(out)


FILE = "shard int, piece int, without_id int, doc_ids binary, id_counts binary, rules binary, symbol_counts binary, symbols array<binary>"
_NAMES = ["shard", "piece", "without_id", "doc_ids", "id_counts", "rules", "symbol_counts", "symbols"]
_TYPES = [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.list_(pa.binary())]


def _deal(bounds: list[int], parts: int):
    def run(batches):
        edges, squeeze = np.array(bounds, np.int64), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1 - zlib.crc32(r) % parts if i is None else int(np.searchsorted(edges, i)) for i, r in zip(ids, raw, strict=True)], pa.int32()), batch.column(0),
                    pa.array([squeeze.compress(r) for r in raw], pa.binary()),
                ],
                names=["shard", "doc_id", "packed"],
            )

    return run


def _write(path: str, terminals: int, end_id: int, chars: int):
    """Sorted rows to rows of the file; a shard of more than ``chars`` bytes has several pieces."""

    def run(batches):
        open_up = zstandard.ZstdDecompressor()
        shard, piece, ids, texts, held = None, 0, [], [], 0

        def flush():
            lengths, parts = encode_texts(texts, path, end_id)
            rules, symbols, per = compress(parts, terminals)
            row = [
                shard, piece, sum(i is None for i in ids), np.array([i for i in ids if i is not None], "<i8").tobytes(), pack(lengths),
                pack(np.column_stack([rules, expansions(rules, terminals)[1][terminals:]]).ravel()), pack(per), [pack(symbols[a : a + CHUNK]) for a in range(0, len(symbols), CHUNK)],
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for s, i, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if ids and (s != shard or held >= chars):
                    yield flush()
                    piece, ids, texts, held = (piece + 1 if s == shard else 0), [], [], 0
                shard = s
                text = open_up.decompress(packed).decode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(text)
                held += len(text)
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, terminals: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = 2_000_000) -> None:
    """Encode every whole text and write the files under ``out``, in ascending id order.

    The format: parquet files of rows ``shard, piece, without_id, doc_ids, id_counts, rules, symbol_counts,
    symbols``. A row holds the documents of a range of ids, in order; the first ``without_id`` of them have none. ``rules`` are
    pairs of symbols of a Re-Pair grammar (symbols below ``terminals`` are ids, rule ``k`` is symbol ``terminals +
    k``), each with the number of ids it expands to; ``symbols`` are the compressed documents, in chunks of ``CHUNK``;
    ``symbol_counts`` and ``id_counts`` are each document's
    number of symbols and of ids; arrays as by ``pack``, ``doc_ids`` as 64-bit integers.

    A null text counts as empty: its ids are the end alone. Rows without an id come first, in shards of numbers below 0; rows
    with equal ids follow each other by their compressed text. A tokenizer that works otherwise than ``encode_texts`` takes it to is refused. An empty table writes no rows. Other columns are ignored.
    """
    refuse_others(path)
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = id_bounds(known, "doc_id", partitions(spark))
    (
        known.mapInArrow(_deal(bounds, partitions(spark)), "shard int, doc_id bigint, packed binary")
        .repartition(partitions(spark), "shard").sortWithinPartitions("shard", "doc_id", "packed")
        .mapInArrow(_write(path, terminals, end_id, shard_chars), FILE)
        .write.parquet(out, compression="none")
    )


def _read(terminals: int):
    def run(batches):
        for batch in batches:
            for shard, piece, without_id, doc_ids, id_counts, rules, symbol_counts, symbols in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                ids, counts, per = np.frombuffer(doc_ids, "<i8"), unpack(id_counts), unpack(symbol_counts)
                flat, size = expansions(unpack(rules).reshape(-1, 3)[:, :2], terminals)
                full, each = spread(flat, size, np.concatenate([unpack(c) for c in symbols]))
                ends = np.cumsum(each)[np.cumsum(per) - 1]
                if not np.array_equal(np.diff(ends, prepend=0), counts):
                    raise ValueError(f"shard {shard}, piece {piece}: the symbols do not expand to the lengths written")
                data = full.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(counts)
                known = pa.array(np.concatenate([np.zeros(without_id, np.int64), ids]), mask=np.arange(n) < without_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, piece, np.int32)), known, pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["shard", "piece", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    return run


def read_digests(spark, out: str, terminals: int) -> DataFrame:
    """Read the files under ``out`` back and expand them: per document ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before: the sums of shards, of which there are as many as
    partitions, are accumulated, then within a shard the sums of its pieces, one row each, and within a piece the expansion lengths give the rest.
    """
    files = spark.read.schema(FILE).parquet(out)
    rows = files.mapInArrow(_read(terminals), "shard int, piece int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = files.select("shard", "piece", "id_counts").mapInArrow(_sizes, "shard int, piece int, ids bigint")
    sum_before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", sum_before(Window.orderBy("shard")).alias("shard_before"))
    pieces = sizes.select("shard", "piece", sum_before(Window.partitionBy("shard").orderBy("piece")).alias("piece_before"))
    before = pieces.join(shards, "shard").select("shard", "piece", (F.col("shard_before") + F.col("piece_before")).alias("before"))
    return rows.join(before, ["shard", "piece"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(unpack(x).sum()) for x in batch.column(2).to_pylist()], pa.int64())], names=["shard", "piece", "ids"])


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents written as ids in the shared folder and read back."""
    import public_tokenizers

    from tidemark.tables import table

    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    path, terminals = public_tokenizers.path("word_bpe_49k.json"), 49_408
    write_tokens(table(spark, sf_dir, "documents"), out, path, terminals)
    return read_digests(spark, out, terminals)
