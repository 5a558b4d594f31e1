"""SentencePiece encoding and decoding: a relational lattice of each distinct word, folded in Spark."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import cut, partitions
from tidemark.llm.tokens import spread
from tidemark.llm.words import mix, text_slices

SPACE = "▁"
#: Words up to this length go through the lattice (their boundaries fit one bigint); longer ones through the library.
LONGEST = 60
#: The piece table is sent to every executor while it has at most so many rows; beyond, it is joined by shuffle.
BROADCAST_PIECES = 1_000_000
#: The most frequent words, so many at most, are sent to every executor with their ids; the rest returns by shuffle.
BROADCAST_WORDS = 1_000_000
#: Characters that are worked on at once.
SLICE = 250_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class Model:
    """A model file: its pieces and byte pieces, and which characters a piece has side by side, as arrays.

    Refused are models whose library would change a text before it is cut (another normalizer than ``identity``, no
    space in front, spaces collapsed), that have user-defined pieces, no byte pieces, or a type other than unigram or BPE.
    The driver reads the file; executors get the arrays, and open the file only for words that are too long for the lattice.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm, kinds = proto.normalizer_spec, proto.SentencePiece
        self.path, self.type = path, proto.trainer_spec.model_type  # 1: unigram, 2: BPE
        as_it_is = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        own = [i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE]
        if not as_it_is or self.type not in (1, 2) or len(own) != 256 or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("a model of this kind is not supported")
        rows = piece_rows(proto)
        self.longest = max((len(t) for t, _, _ in rows), default=1)
        self.least = min((x for _, _, x in rows), default=0.0)
        self.bytes = np.zeros(256, np.int32)
        self.bytes[[int(proto.pieces[i].piece[1:-1], 16) for i in own]] = own
        raw = [b""] * len(proto.pieces)
        for text, i, _ in rows:
            raw[i] = text.replace(SPACE, " ").encode()
        for value, i in enumerate(self.bytes.tolist()):
            raw[i] = bytes([value])
        self.chars = np.full(0x110000, -1, np.int32)
        for text, i, _ in rows:
            if len(text) == 1:
                self.chars[ord(text)] = i
        self.chars[0] = -1  # stands for no character
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        beside = {t[k : k + 2] for t, _, _ in rows for k in range(len(t) - 1)}
        if any("\n" in x for x in beside):
            raise ValueError("a model of this kind is not supported")
        chars = sorted({c for x in beside for c in x})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x in beside:
            self.beside[self.kind[ord(x[0])], self.kind[ord(x[1])]] = True

    def long_ids(self, word: str) -> list[int]:
        """A long word by the library: after a space it is a text; else it follows a line break, which no piece crosses."""
        model = library(self.path)
        if word.startswith(SPACE):
            return model.encode(word[1:].replace(SPACE, " ")) if len(word) > 1 else model.encode(" ")[:1]
        return model.encode("\n" + word.replace(SPACE, " "))[2:]

    def widen(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ids, in which minus a code point stands for a character: with its piece, or an id for each of its bytes."""
        code = -np.minimum(flat, 0)
        flat = np.where(self.chars[code] >= 0, self.chars[code], flat)
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, size
        as_bytes = [self.bytes[np.frombuffer(chr(-int(c)).encode("utf-8", "surrogatepass"), np.uint8)] for c in flat[odd]]
        each = np.ones(len(flat), np.int64)
        each[odd] = [len(x) for x in as_bytes]
        ends = np.cumsum(each)
        wide = np.repeat(flat, each)
        for k, x in zip(odd, as_bytes, strict=True):
            wide[ends[k] - len(x) : ends[k]] = x
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])]
        return wide, np.diff(bounds)


def piece_rows(proto) -> list[tuple[str, int, float]]:
    """``sub, id, score`` of the pieces that text can match."""
    return [(p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type == proto.SentencePiece.NORMAL]


@lru_cache(maxsize=1)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


_RANDOM = mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(1))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def hashes_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points."""
    with np.errstate(over="ignore"):
        n = len(codes) + 1
        if len(_POWERS[0]) < n <= 1 << 19:
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << 19, base, np.uint64)])) for base in (_BASE, _INVERSE)]
        up, down = _POWERS if len(_POWERS[0]) >= n else [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)])) for base in (_BASE, _INVERSE)]
        value = _RANDOM[codes & np.uint32(0xFFFF)]
        high = codes >> np.uint32(16)
        if high.any():
            value ^= high * np.uint64(0xD1B54A32D192ED03)
        value |= np.uint64(1)
        value *= up[: n - 1]
        total = np.zeros(n, np.uint64)
        np.cumsum(value, out=total[1:])
        return mix((total[end] - total[start]) * down[start])


class Units:
    """The words of some texts, spaces marked: a text is cut wherever no piece of the model has the two characters side by side.

    No piece crosses such a place, so neither a merge nor a path does, and a text's ids are those of its words in a row.
    ``start`` and ``end`` are places in ``joined``; ``first`` has the index of each text's first word, and one more entry.
    """

    def __init__(self, texts: list[str | None], model: Model):
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        self.joined = "".join(marked)
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in marked]) if marked else np.zeros(0, np.int64)
        new = np.zeros(len(codes) + 1, bool)
        if len(codes):
            kind = model.kind[codes]
            new[1:-1] = ~model.beside[kind[:-1], kind[1:]]
            new[0] = True
        new[ends] = True
        new[-1] = False
        self.start = np.flatnonzero(new)
        self.end = np.concatenate([self.start[1:], [len(codes)]]).astype(np.int64)[: len(self.start)]
        self.hash = hashes_of(codes, self.start, self.end)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)

    def word(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``Units`` gives these words."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(words), 20_000):
        part = words[lo : lo + 20_000]
        end = np.cumsum([len(w) for w in part])
        out.append(hashes_of(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], end[:-1]]), end))
    return np.concatenate(out)


def piece_table(spark, path: str) -> DataFrame:
    """``sub, id, score`` of the pieces that text can match."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library(path).serialized_model_proto())
    return spark.createDataFrame(piece_rows(proto), "sub string, id int, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int, shortest: int = 1) -> DataFrame:
    """The lattice of each distinct ``word``: ``word, n, edges`` (structs ``cost, i, j, id``, the best score first), and the words' other columns.

    Substrings of ``shortest`` to ``longest`` characters are exploded and joined to the piece table. Words
    come partitioned by word and stay so, so that grouping the edges needs no further exchange.
    """
    if pieces.count() <= BROADCAST_PIECES:
        pieces = F.broadcast(pieces)
    own = words.columns
    words = words.withColumn("h", F.xxhash64("word"))  # rows sort by it faster than by the word
    last, first = F.greatest(F.lit(1), F.length("word") - (shortest - 1)), F.when(F.col("i") == 1, F.lit(1)).otherwise(F.lit(shortest))
    spans = (
        words.select("h", *own, F.explode(F.sequence(F.lit(1), last)).alias("i"))
        .select("h", *own, "i", F.explode(F.sequence(first, F.least(F.lit(longest), F.length("word") - F.col("i") + 1))).alias("size"))
        .select("h", *own, (F.col("i") - 1).alias("i"), (F.col("i") - 1 + F.col("size")).alias("j"), F.expr("substring(word, i, size)").alias("sub"))
    )
    # substrings that are no piece go before the grouping; a word's first character stays, so that every word does
    edges = spans.join(pieces, "sub", "left").where("id is not null or j = 1")
    edge = F.when(F.col("id").isNotNull() & (F.col("j") - F.col("i") >= shortest), F.struct((-F.col("score")).alias("cost"), "i", "j", "id"))
    return edges.groupBy("h", *own).agg(F.sort_array(F.collect_list(edge)).alias("edges")).drop("h").withColumn("n", F.length("word"))


def segments_ids(mask: Column) -> Column:
    """The ids of the segments between the boundaries in ``mask``; a character without an edge is minus its code point."""
    return F.expr("""
        transform(filter(sequence(0, n - 1), p -> shiftright(mask, p) & 1L = 1L), p ->
          coalesce(
            try_element_at(filter(edges, e -> e.i = p and e.j = coalesce(array_min(filter(sequence(p + 1, n), q -> shiftright(mask, q) & 1L = 1L)), n)), 1).id,
            -ascii(substring(word, p + 1, 1))))
    """)


def fold_merges(graph: DataFrame) -> DataFrame:
    """Ids of each word by the merges of a BPE model: ``word, ids``.

    The state is the set of boundaries, as bits, and the edges that may still merge. Each step takes the edge of best score, leftmost
    among equals, that has just one boundary inside, and drops that one; edges that lost an end or
    have nothing inside any more leave the state, so that later steps scan few.
    """
    own = [c for c in graph.columns if c not in ("n", "edges")]
    first = "coalesce(try_element_at(filter(st.left, e -> bit_count(st.m & e.inner) = 1), 1).inner, 0L)"
    return (
        graph.withColumn("mask", F.expr(f"""
            aggregate(sequence(1, n), named_struct('m', shiftleft(1L, n + 1) - 1L, 'left', transform(filter(edges, e -> e.j - e.i > 1), e -> named_struct(
                'ends', shiftleft(1L, e.i) | shiftleft(1L, e.j), 'inner', (shiftleft(1L, e.j) - 1L) ^ (shiftleft(1L, e.i + 1) - 1L)))),
              (st, k) -> element_at(transform(array(st.m & ~{first}), m ->
                named_struct('m', m, 'left', filter(st.left, e -> (m & e.ends) = e.ends and (m & e.inner) <> 0L))), 1),
              st -> st.m)
        """))
        .select(*own, segments_ids(F.col("mask")).alias("ids"))
    )


def fold_viterbi(graph: DataFrame, unknown_cost: float = 1e4) -> DataFrame:
    """Ids of each word on the path of the greatest sum of scores (unigram models): ``word, ids``.

    The state holds, for each boundary so far, the least cost to reach it and the boundaries of that
    path as bits; equal costs go to the shorter last piece. A character without a piece costs ``unknown_cost``.
    """
    cost, bits, own = "double", "bigint", [c for c in graph.columns if c not in ("n", "edges")]
    return (
        graph.withColumn("best", F.expr(f"""
            aggregate(sequence(1, n), array(named_struct('cost', cast(0 as {cost}), 'bits', cast(1 as {bits}))), (state, b) ->
              concat(state, array(array_min(concat(
                transform(filter(edges, e -> e.j = b), e -> named_struct('cost', element_at(state, e.i + 1).cost + e.cost, 'bits', element_at(state, e.i + 1).bits | shiftleft(1L, b))),
                array(named_struct('cost', element_at(state, b).cost + cast({unknown_cost} as {cost}), 'bits', element_at(state, b).bits | shiftleft(1L, b))))))))
        """))
        .withColumn("mask", F.expr("element_at(best, -1).bits"))
        .select(*own, segments_ids(F.col("mask")).alias("ids"))
    )


def _counted(shared):
    """Texts to their distinct words, with how often each occurs."""

    def run(batches):
        model = shared.value
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), SLICE):
                u = Units(texts, model)
                short = np.flatnonzero(u.end - u.start <= LONGEST)
                _, at, n = np.unique(u.hash[short], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([u.word(i) for i in short[at].tolist()], pa.string()), pa.array(n.astype(np.int64))], names=["word", "count"])

    return run


def _pack(blocks: int):
    """Texts dealt to blocks, compressed; the task's number keeps equal rows apart."""

    def run(batches):
        from pyspark import TaskContext

        squeeze, salt = zstandard.ZstdCompressor(level=6), f"{TaskContext.get().partitionId()}:".encode()
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                raw, ids = [(t or "").encode("utf-8", "surrogatepass") for t in texts], batch.column(0).slice(a, b - a)
                block = [zlib.crc32(salt + f"{i}:".encode() + r) % blocks for i, r in zip(ids.to_pylist(), raw, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), ids, pa.array([squeeze.compress(r) for r in raw], pa.binary())], names=["block", "id", "packed"])

    return run


def _texts(packed) -> list[str]:
    open_up = zstandard.ZstdDecompressor()
    return [open_up.decompress(p).decode("utf-8", "surrogatepass") for p in packed]


def _rare_words(shared, hot):
    """Rows sorted by block to the distinct short words of each block that are not sent to every executor."""

    def run(batches):
        model, known = shared.value, hot.value[0]
        at, seen = None, {}

        def flush():
            words = list(seen.values())
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int32()), pa.array(part, pa.string())], names=["block", "word"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for lo in np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist() if len(blocks) else []:
                if blocks[lo] != at:
                    yield from flush()
                    at, seen = int(blocks[lo]), {}
                hi = int(np.searchsorted(blocks, at, "right"))
                for _, _, packed in text_slices(batch.column(2).slice(lo, hi - lo), SLICE // 2):
                    u = Units(_texts(packed), model)
                    kinds, where = np.unique(u.hash, return_index=True)
                    new = (u.end - u.start)[where] <= LONGEST
                    if len(known):
                        new &= known[np.minimum(np.searchsorted(known, kinds), len(known) - 1)] != kinds
                    seen.update((h, u.word(i)) for h, i in zip(kinds[new].tolist(), where[new].tolist(), strict=True) if h not in seen)
        yield from flush()

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of lists as all values in a row and the number of each list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, np.int32), np.diff(offsets)


def _dictionary(model: Model, words: list[str], flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with their ids in order of the words' hashes: hashes, all ids in a row, and where each word's begin, with the end."""
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    flat, size = model.widen(flat, size)
    return hashes[order], spread(flat, size, order)[0].astype(np.int32), np.concatenate([[0], np.cumsum(size[order])]).astype(np.int32)


def frequent_words(encoded: DataFrame, shared, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that occur ``2**k`` times or more, for the least k that leaves at most ``most``, with their ids.

    What reaches the driver is bounded by ``most``; the counts that decide are one row for each power of two.
    """
    sizes = {r.k: r.n for r in encoded.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    low, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        low = k
    def hashed(batches):
        for batch in batches:
            flat, size = shared.value.widen(*_lists(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word_hashes(batch.column(0).to_pylist()).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.astype(np.int32)))], names=["h", "ids"]
            )

    rows = encoded.where(F.floor(F.log2("count")) >= low).select("word", "ids").mapInArrow(hashed, "h bigint, ids array<int>").toArrow()
    flat, size = _lists(rows.column("ids")) if rows.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    hashes = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], spread(flat, size, order)[0].astype(np.int32), np.concatenate([[0], np.cumsum(size[order])]).astype(np.int32)


def _assemble(shared, hot, schema: pa.Schema):
    """A block's texts and its rare words' ids to the ids and the decoded text of each document."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        model = shared.value
        flat, size = _lists(words.column("ids")) if words.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        rare = _dictionary(model, words.column("word").to_pylist(), flat, size)
        all_ids, decoded, exact = [np.zeros(0, np.int32)], [], []
        sizes = []
        for _, _, packed in text_slices(docs.column("packed").combine_chunks(), SLICE // 2):
            texts = _texts(packed)
            u = Units(texts, model)
            kinds, at, which = np.unique(u.hash, return_index=True, return_inverse=True)
            long = np.flatnonzero((u.end - u.start)[at] > LONGEST)
            long_ids = [model.long_ids(u.word(i)) for i in at[long].tolist()]
            runs, number = [], np.full(len(kinds), -1)
            counts: list[np.ndarray] = []
            taken = 0
            for hashes, ids, begin in (hot.value, rare):
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, kinds), len(hashes) - 1)
                    mine = np.flatnonzero((hashes[place] == kinds) & (number < 0))
                    first = begin[place[mine]].astype(np.int64)
                    n = begin[place[mine] + 1] - first
                    runs.append(ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                    counts.append(n.astype(np.int64))
                    number[mine] = taken + np.arange(len(mine))
                    taken += len(mine)
            number[long] = taken + np.arange(len(long))
            runs += [np.array(x, np.int32) for x in long_ids]
            counts.append(np.array([len(x) for x in long_ids], np.int64))
            if (number < 0).any():
                raise ValueError("a block's words and their ids do not match")
            own = np.concatenate(counts)
            ids, each = spread(np.concatenate([np.zeros(0, np.int32), *runs]), own, number[which])
            ends = np.concatenate([[0], np.cumsum(each)])[u.first]
            back, per = spread(model.raw, model.raw_size, ids)
            cuts = np.concatenate([[0], np.cumsum(per)])[ends]
            data = back.tobytes()
            all_ids.append(ids.astype(np.int32))
            sizes.append(np.diff(ends))
            for text, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                decoded.append(data[a + 1 : b].decode("utf-8", "surrogatepass"))
                exact.append(decoded[-1] == text)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int32)
        return pa.Table.from_arrays(
            [docs.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids))), pa.array(decoded, pa.string()), pa.array(exact, pa.bool_())],
            schema=schema,
        )

    return run


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """Ids of each distinct ``word`` through the lattice, with the words' other columns; BPE models fold merges in order of score, unigram models fold Viterbi."""
    merges = model.type == 2  # a merge gives two characters at least; single ones keep their place
    graph = lattice(words, piece_table(words.sparkSession, model.path), model.longest, 2 if merges else 1)
    return fold_merges(graph) if merges else fold_viterbi(graph, 10 - model.least)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2_000_000, most: int = BROADCAST_WORDS) -> DataFrame:
    """Ids of every whole text and the text decoded from them: ``id, ids, decoded, round_trip``.

    Texts are cut into words that no piece crosses (``Units``). Distinct words are counted and go through the lattice once
    (``encode_words``). The most frequent ones, at most ``most``, are sent to every executor
    with their ids. Documents are dealt to blocks of about ``block_chars`` characters; the rarer words of a block are joined to their
    ids, which return to the block, where the documents are put together. A character without a
    piece is given by its bytes. Words longer than 60 characters are encoded by the library.

    A null or empty text has no ids and decodes to the empty text. Null ids and repeated rows stay.
    A text that holds U+2581 decodes with a space for it, as in the library, and ``round_trip`` is
    false. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = Model(path)
    shared = spark.sparkContext.broadcast(model)
    counted = known.select("text").mapInArrow(_counted(shared), "word string, count bigint").groupBy("word").agg(F.sum("count").alias("count"))
    encoded = cut(encode_words(counted, model))
    chars = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n  # words of any length
    hot = spark.sparkContext.broadcast(frequent_words(encoded, shared, most))
    parts = partitions(spark)
    # both uses of the dealt texts read all columns, so that the exchange is written once
    packed = known.mapInArrow(_pack(-(-chars // block_chars) or 1), f"block int, id {kind.simpleString()}, packed binary").repartition(2 * parts, "block")
    refs = packed.sortWithinPartitions("block").mapInArrow(_rare_words(shared, hot), "block int, word string")
    filled = refs.join(encoded.select("word", "ids"), "word").select("block", "word", "ids")
    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("round_trip", pa.bool_())])
    return packed.groupBy("block").cogroup(filled.groupBy("block")).applyInArrow(_assemble(shared, hot, schema), f"id {kind.simpleString()}, ids array<int>, decoded string, round_trip boolean")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: numbers of ids, a hash of the ids and of the decoded text."""
    import public_tokenizers

    from tidemark.tables import table

    got = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.md5(F.encode("decoded", "UTF-8")).alias("decoded_md5"), "round_trip",
    )
