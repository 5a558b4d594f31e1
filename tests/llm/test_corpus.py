"""The corpus operators against brute force on small fixtures, and on nulls, empty, long, tied and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, fingerprint, language, licenses, lines, minhash, passages, pieces, tokens, urls
from tidemark.llm.common import components
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BPE, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def vocabulary(n=400, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    long = prose(random.Random(3), vocabulary(), 30_000)
    texts = [None, "", " \n\t\n ", "a", "a b c d", "MIT", long, long, "same five words in here now", "same five words in here now", "日本語 \U0001f600 ﬁ é", "x" * 5000, "7 8 9 ..."]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", None) for i, t in enumerate(texts)]
    return [*rows, (None, "no id here at all today", "en", "s", 3), (3, "a", "en", None, 1), (3, "a", "en", None, 1)]


def runs_of(spark, rows):
    """Every operator over the rows, which carry columns of names that operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "key", "line", "doc", "word", "a", "digest", "_kept", "removed", "first", "score", "h"):
        df = df.withColumn(name, F.lit("clash"))
    bench = spark.createDataFrame([(1, "same five words in here now"), (2, None), (3, ""), (4, "a")], "item_id bigint, text string")
    return df, {
        "pieces": lambda: pieces.encode_decode(df, BPE),
        "passages": lambda: passages.repeated_passages(df),
        "leaks": lambda: decontaminate.leaks(df, bench),
        "clean": lambda: decontaminate.without_leaks(df, bench),
        "licenses": lambda: licenses.scan(df.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/x")).alias("path"), "text", "line", "key")),
        "near": lambda: minhash.near_duplicates(df),
        "language": lambda: language.identify(df, language.training_texts(df)),
        "fingerprints": lambda: fingerprint.fingerprints(df),
        "lines": lambda: lines.dedup_lines(df),
        "urls": lambda: urls.judge(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "key", "line"), [urls.host_rule("block", "net/")]),
    }


KEEPS_ROWS = ("pieces", "licenses", "near", "language", "fingerprints", "lines", "urls")


@pytest.mark.parametrize("name", sorted([*KEEPS_ROWS, "passages", "leaks", "clean"]))
def test_odd_rows(spark, odd_rows, name):
    df, made = runs_of(spark, odd_rows)
    got = made[name]().collect()
    if name in KEEPS_ROWS:
        assert len(got) == len(odd_rows)
    if name == "near":
        by = {r.doc_id: r for r in got}
        assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[0].kept and by[3].n_shingles == 1
        assert by[7].component_id == 6 and by[9].component_id == 8 and not by[None].kept
    if name == "leaks":
        assert {(r.doc_id, r.item_id) for r in got} == {(8, 1), (9, 1), (3, 4), (4, 4)}
    if name == "clean":
        assert set(got[0].asDict()) == set(df.columns) and len(got) == len(odd_rows) - 6
    if name == "language":
        assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2, 12))


@pytest.mark.parametrize("name", sorted([*KEEPS_ROWS, "passages", "leaks", "clean"]))
def test_empty_table(spark, name):
    assert runs_of(spark, [])[1][name]().count() == 0


def test_empty_token_files(spark, tmp_path):
    tokens.write_tokens(spark.createDataFrame([], DOCS), f"file://{tmp_path}/t", WORDS, 49408)
    assert spark.read.schema(tokens.FILE).parquet(f"file://{tmp_path}/t").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


# --- 1


def test_pieces_match_the_library(spark, odd_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=BPE)
    texts = [t for _, t, *_ in odd_rows] + ["a  b", "   ", "x\n y\n\n z ", "▁x", "word\r\n}\r\n", "\U0001f600" * 70 + "\n" + "一" * 80, "a" * 200]
    got = {r.id: r for r in pieces.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), BPE).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert list(got[i].ids) == ids and got[i].decoded == model.decode(ids)
        assert got[i].round_trip == ("▁" not in (t or ""))


def test_viterbi_is_the_best_path(spark):
    table = [("a", 1, -1.0), ("b", 2, -1.0), ("ab", 3, -1.5), ("ba", 4, -2.5), ("aba", 5, -2.6), ("c", 6, -0.1)]
    costs = {p: (i, -s) for p, i, s in table}

    def brute(w):
        best = {0: (0.0, ())}
        for j in range(1, len(w) + 1):
            options = [(best[i][0] + costs[w[i:j]][1], best[i][1] + (costs[w[i:j]][0],)) for i in range(j) if w[i:j] in costs]
            options.append((best[j - 1][0] + 1e4, best[j - 1][1] + (costs[w[j - 1]][0] if w[j - 1] in costs else -ord(w[j - 1]),)))
            best[j] = min(options)
        return best[len(w)]

    words = ["a", "ab", "aba", "abab", "cabx", "bab"]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(2, "word")
    graph = pieces.lattice(df, spark.createDataFrame(table, "sub string, id int, score double"), 3)
    flip = {i: c for i, c in costs.values()}
    for r in pieces.fold_viterbi(graph).collect():
        assert abs(sum(flip.get(i, 1e4) for i in r.ids) - brute(r.word)[0]) < 1e-6


def unigram_model(path, pieces_, **normal):
    """A unigram model file of the pieces ``(text, score)``, with a piece for each byte."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    kinds = proto.SentencePiece
    for text, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL)):
        proto.pieces.add(piece=text, score=0.0, type=kind)
    for b in range(256):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=kinds.BYTE)
    for text, score in pieces_:
        proto.pieces.add(piece=text, score=score, type=kinds.NORMAL)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.vocab_size = 1, True, len(proto.pieces)
    spec = proto.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", True, False, True
    for k, v in normal.items():
        setattr(spec, k, v)
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_unigram_models_match_the_library(spark, tmp_path):
    import sentencepiece

    r = random.Random(61)
    table = {"▁": -3.0, **{c: -4 - r.random() for c in "abcdef,"}}
    while len(table) < 120:
        table["".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))] = -5 - 6 * r.random()
    table |= {"▁" + t: -5 - 6 * r.random() for t in list(table)[10:60]}
    path = unigram_model(tmp_path / "u.model", sorted(table.items()))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" ".join("".join(r.choice("abcdefx,") for _ in range(r.randint(1, 12))) for _ in range(8)) for _ in range(60)] + ["", None, "  a  ", "日本 é", "ab\ncd"]
    got = {x.id: x for x in pieces.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == model.encode(t or "") and got[i].round_trip, t


def test_models_of_other_kinds_are_refused(tmp_path):
    with pytest.raises(ValueError, match="not supported"):
        pieces.Model(unigram_model(tmp_path / "a.model", [("a", -1.0)], remove_extra_whitespaces=True))
    with pytest.raises(ValueError, match="not supported"):
        pieces.Model(unigram_model(tmp_path / "b.model", [("a", -1.0)], name="nmt_nfkc"))


def test_rare_words_return_to_their_blocks(spark):
    import sentencepiece

    model, r = sentencepiece.SentencePieceProcessor(model_file=BPE), random.Random(62)
    texts = [prose(r, vocabulary(300), 80) for _ in range(40)] + ["same text of a few words"] * 30
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)]
    for most in (0, 20, 1000):
        got = pieces.encode_decode(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), BPE, block_chars=2000, most=most).collect()
        assert sorted((x.id or -1, x.decoded, tuple(x.ids)) for x in got) == sorted((i or -1, t, tuple(model.encode(t))) for i, t in rows)


# --- 2


def test_passages_are_found_with_edits(spark):
    r, words = random.Random(5), vocabulary(3000)
    shared = prose(r, words, 70)
    edited = shared.split()
    edited[30] = "changed"
    edited.insert(50, "added")
    rows = [(i, prose(r, words, 200)) for i in range(20)]
    rows += [(20, prose(r, words, 40) + " " + shared + " " + prose(r, words, 30)), (21, " ".join(edited)), (22, shared.upper()), (23, prose(r, words, 100))]
    got = {(x.doc, x.other): x for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {(21, 20), (22, 20)}
    x = got[(22, 20)]
    assert (x.a, x.b, x.c, x.e, x.same) == (0, 70, 40, 110, 70)
    assert got[(21, 20)].same == 69 and got[(21, 20)].b == 71


def test_chains_are_the_best_of_all():
    r, single = random.Random(2), 0
    for _ in range(600):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randint(2, 10))})
        score, back = [], []
        for x, y in pts:
            gain, from_ = max(((score[k] - 10 * abs((x - y) - (u - v)) - (x - u), k) for k, (u, v) in enumerate(pts[: len(score)]) if 0 < x - u <= 40 and 0 < y - v <= 40), default=(0, -1))
            gain, from_ = (gain, from_) if gain > 0 else (0, -1)
            score.append(gain + 20 * (8 if from_ < 0 else min(8, x - pts[from_][0], y - pts[from_][1])))
            back.append(from_)
        got = passages.chains(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]))
        assert all(a < b and c < e for a, b, c, e in got)
        if sum(x == max(score) for x in score) == 1:
            single, i = single + 1, score.index(max(score))
            j = i
            while back[j] >= 0:
                j = back[j]
            assert got[0] == (pts[j][0], pts[i][0] + 8, pts[j][1], pts[i][1] + 8)
    assert single > 300


def test_alignment_counts_common_words():
    assert passages.align(np.array([1, 2, 3, 4, 5, 6]), np.array([1, 2, 9, 4, 6])) == 4


def test_chains_are_those_of_brute_force():
    r = random.Random(31)
    for _ in range(30):
        pts, at, skew = [], 0, 0
        for _ in range(r.randint(2, 4)):  # several passages of a pair, out of reach of each other
            pts += [(at + k, at + skew + k) for k in range(0, r.choice((30, 120)), 3)]
            at, skew = pts[-1][0] + r.randint(41, 120), skew + r.randint(-20, 20)
        pts = sorted({*pts, *((r.randrange(400), r.randrange(400)) for _ in range(20))})
        score, back = [], []
        for i, (x, y) in enumerate(pts):
            gain, from_ = max(
                ((score[k] - 0.5 * abs((x - y) - (u - v)) - 0.05 * (x - u), k) for k, (u, v) in enumerate(pts[:i]) if 0 < x - u <= 40 and 0 < y - v <= 40), default=(0.0, -1)
            )
            if gain <= 0:
                gain, from_ = 0.0, -1
            score.append(gain + (8 if from_ < 0 else min(8, x - pts[from_][0], y - pts[from_][1])))
            back.append(from_)
        best = max(score)
        ends = set()
        for i in range(len(pts)):
            if score[i] > best - 1e-9:
                j = i
                while back[j] >= 0:
                    j = back[j]
                ends.add((pts[j][0], pts[i][0] + 8, pts[j][1], pts[i][1] + 8))
        got = passages.chains(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]))
        assert got[0] in ends
        assert sum(b - a >= 30 for a, b, _, _ in got) >= 2


def test_every_separated_passage_is_found(spark):
    r, words = random.Random(32), vocabulary(3000)
    shared = [prose(r, words, n) for n in (100, 60, 55)]
    rows = [(1, " ".join(prose(r, words, 60) + " " + s for s in shared)), (2, " ".join(prose(r, words, 60) + " " + s for s in shared))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x.a, x.b, x.c, x.e, x.same) for x in got) == [(60, 160, 60, 160, 100), (220, 280, 220, 280, 60), (340, 395, 340, 395, 55)]


def test_a_passage_that_two_others_hold_in_pieces(spark):
    r, words = random.Random(34), vocabulary(3000)
    one, two, fill = prose(r, words, 40), prose(r, words, 40), lambda: prose(r, words, 60)
    rows = [(1, fill() + " " + one), (2, two + " " + fill()), (3, fill() + " " + one + " " + two), (4, one + " " + two + " " + fill())]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(x.doc, x.other, x.a, x.b, x.c, x.e, x.same) for x in got] == [(4, 3, 0, 80, 60, 140, 80)]


def test_every_run_of_fifty_words_is_found(spark):
    r, words = random.Random(35), vocabulary(3000)
    parts = [prose(r, words, n) for n in (20, 24, 25, 26, 30, 49, 50, 51, 60, 75) for _ in range(3)]
    texts = [" ".join(r.choice(parts) if r.random() < 0.8 else prose(r, words, r.randint(1, 30)) for _ in range(r.randint(1, 8))) for _ in range(120)]
    texts += [texts[3], texts[50], texts[3]]
    rows = list(enumerate(texts))
    found: dict[int, set[int]] = {}
    for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        own, its = texts[x.doc].split(), texts[x.other].split()
        assert x.other < x.doc and min(x.b - x.a, x.e - x.c) >= 50 and x.b <= len(own) and x.e <= len(its)
        found.setdefault(x.doc, set()).update(range(x.a, x.b))
    seen: set[tuple] = set()
    n = 0
    for i, t in rows:
        w = t.split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, run in enumerate(runs):
            if run in seen:
                n += 1
                assert set(range(k, k + 50)) <= found.get(i, set()), (i, k)
        seen.update(runs)
    assert n > 1000


def test_shared_words_too_few_at_the_ends_of_texts(spark):
    r, words = random.Random(38), vocabulary(3000)
    few = prose(r, words, 32)
    rows = [(1, prose(r, words, 90) + " " + few), (2, prose(r, words, 70) + " " + few), (3, few + " " + prose(r, words, 60)), (4, few), (5, few + " " + few)]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() == []


def test_most_edited_passages_are_found(spark):
    r, words = random.Random(36), vocabulary(4000)
    rows, want = [], set()
    for k in range(100):
        base = prose(r, words, 70).split()
        edited = list(base)
        for p in r.sample(range(70), 4):  # one word in eighteen
            edited[p] = r.choice(words)
        rows += [(2 * k, " ".join([prose(r, words, 30), *base, prose(r, words, 30)])), (2 * k + 1, " ".join([prose(r, words, 20), *edited, prose(r, words, 40)]))]
        want.add((2 * k + 1, 2 * k))
    got = {(x.doc, x.other) for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_passages_of_repeated_and_null_ids(spark):
    r, words = random.Random(37), vocabulary(3000)
    a, b = prose(r, words, 60), prose(r, words, 70)
    rows = [(1, a), (2, b), (5, "x " + a), (5, b + " y"), (5, b + " y"), (None, a), (None, b), (3, None), (4, ""), (6, a)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x.doc, x.other, x.a, x.b, x.same) for x in got) == [(5, 1, 1, 61, 60), (5, 2, 0, 70, 70), (6, 1, 0, 60, 60)]


# --- 3


def test_wand_finds_all(spark):
    r, words = random.Random(8), vocabulary(150)
    items = [(i, prose(r, words, r.randint(3, 40))) for i in range(60)]
    from collections import Counter

    from tidemark.llm.words import Words

    w = Words([t for _, t in items], plain=True)
    df = Counter(h for i in range(60) for h in set(w.hash[w.first[i] : w.first[i + 1]].tolist()))
    ix = decontaminate.build(items, 60, df, len(w.hash) / 60)
    text = [prose(r, words, 300) + " " + items[7][1] + " " + prose(r, words, 50), items[3][1], ""]
    tw = Words(text, plain=True)
    for least in (0.3, 0.6):
        want, stride = set(), max(64, ix.longest)
        for t in range(3):
            own = tw.hash[tw.first[t] : tw.first[t + 1]]
            for s in range(0, len(own), stride):
                terms = set(own[s : s + stride + ix.longest].tolist())
                score = [0.0] * 60
                for k, h in enumerate(ix.terms.tolist()):
                    if h in terms:
                        for p in range(ix.first[k], ix.first[k + 1]):
                            score[ix.items[p]] += ix.impacts[p]
                want |= {(t, i) for i in range(60) if score[i] >= least - 1e-9}
        assert set(decontaminate.search(ix, tw, least)) == want


def test_an_index_stays_small():
    """As many items and terms as an index may have take memory by postings, not by blocks times terms."""
    from collections import Counter

    from tidemark.llm.words import Words

    r, words = random.Random(81), vocabulary(30_000, seed=82)
    items = [(i, prose(r, words, 24)) for i in range(12_000)]
    assert sum(len(t) for _, t in items) > 0.8 * decontaminate.INDEX_CHARS
    w = Words([t for _, t in items], plain=True)
    ix = decontaminate.build(items, len(items), Counter(w.hash.tolist()), 24)
    assert sum(x.nbytes for x in (ix.terms, ix.first, ix.items, ix.impacts, ix.block_at, ix.block_max)) < 16 * decontaminate.INDEX_CHARS
    texts = [prose(r, words, 400) + " " + items[k][1] for k in range(0, 12_000, 400)]
    assert decontaminate.search(ix, Words(texts, plain=True), 0.6) == [(k, 400 * k) for k in range(30)]


# --- 4


def test_licenses_are_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "a/b/c.txt", "nothing"),
        (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "z/y", "text\nReleased under the MIT License.\nmore words here than in the line above it"), (5, "z/x", None), (6, None, "q"), (7, "a/d", ""),
    ]
    got = {r.id: (r.license, r.origin, r.from_path) for r in licenses.scan(spark.createDataFrame(rows, "id bigint, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("Apache-2.0", "inherited", "a/b/COPYING"), 3: ("Apache-2.0", "file", None), 4: ("MIT", "header", None), 5: (None, None, None), 6: (None, None, None),
        7: ("MIT", "inherited", "a/LICENSE"),
    }


def test_whole_license_files(spark):
    texts = dict(licenses.file_templates())
    rows = [(i, f"{name}/LICENSE", f"Copyright (c) 2020 Somebody Else\n\n{text.upper()}") for i, (name, text) in enumerate(sorted(texts.items()))]
    rows += [(100 + i, f"{name}/src/deep/x.c", "int main;") for i, name in enumerate(sorted(texts))]
    rows += [(200, "q/x", "Licensed under the MIT license."), (200, "q/x", "Licensed under CC BY 4.0.\nand a good many other words of no licence"), (201, "prose/LICENSE", "some words that are no licence at all " * 20)]
    got = [(r.id, r.license, r.origin, r.from_path) for r in licenses.scan(spark.createDataFrame(rows, "id bigint, path string, text string")).collect()]
    want = [(i, name, "file", None) for i, name in enumerate(sorted(texts))] + [(100 + i, name, "inherited", f"{name}/LICENSE") for i, name in enumerate(sorted(texts))]
    assert sorted(got, key=str) == sorted([*want, (200, "MIT", "header", None), (200, "CC-BY-4.0", "header", None), (201, None, None, None)], key=str)


# --- 5


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates_are_the_components(spark):
    r, words = random.Random(4), vocabulary()
    rows = []
    for _ in range(6):
        base = prose(r, words, 150).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_one_row_of_each_group_stays(spark):
    r, words = random.Random(41), vocabulary()
    base = [prose(r, words, 60) for _ in range(8)]
    near = lambda t: t + " one more"
    rows = [
        (5, base[0]), (5, base[1]), (7, near(base[0])), (8, near(base[1])),  # one id, two texts, each with a copy
        (None, base[2]), (None, near(base[2])), (None, base[3]), (9, near(base[3])), (None, base[4]),  # without ids
        (3, base[5]), (3, base[5]), (2, near(base[5])), (1, base[6]), (1, base[6]), (4, None), (4, None), (6, ""), (6, ""),
    ]
    rows = [(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(rows)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    kept = {int(x.source[1:]) for x in got}
    assert len(got) == len(kept) and {0, 1, 7, 8, 11, 14, 15, 16, 17} <= kept
    assert len(kept & {4, 5}) == 1 and len(kept & {12, 13}) == 1 and len(kept) == 11
    got = [(x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id bigint, text string")).collect()]
    want = [(5, 5, True)] * 2 + [(7, 5, False), (8, 5, False), (None, None, False), (None, None, False), (None, 9, False), (9, 9, True), (None, None, False)]
    assert sorted(got, key=str) == sorted([*want, (3, 2, False), (3, 2, False), (2, 2, True), *[(1, 1, True)] * 2, *[(4, 4, True)] * 2, *[(6, 6, True)] * 2], key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- 6


def test_phrases_are_the_longest_matches():
    r = random.Random(6)
    trained = (("x", "".join(r.choice("abc ") for _ in range(300))), ("y", "".join(r.choice("bcd") for _ in range(300))))
    trained = tuple((k, language.fold(t)) for k, t in trained)
    texts = ["".join(r.choice("abcd e") for _ in range(n)) for n in (1, 50, 127, 128, 129, 400)] + [None, "", "12"]
    sizes, counts = language.phrases(texts, language.machines(trained))
    code = language.machines(trained)[0]
    for i, t in enumerate(texts):
        chars = [("?" if code[ord(c)] == 2 else c) if c.isalpha() else " " for c in (t or "").lower()]
        kept = [c for k, c in enumerate(chars) if c != " " or k and chars[k - 1] != " "] if any(c != " " for c in chars) else []
        assert sizes[i] == len(kept)
        for k, (_, corpus) in enumerate(trained):
            n = 0
            for a in range(0, len(kept), language.LANE):
                lane, p = "".join(kept[a : a + language.LANE]), 0
                while p < len(lane):
                    q = p + 1
                    while q < len(lane) and lane[p : q + 1] in corpus:
                        q += 1
                    if lane[p] not in corpus:
                        q = p + 1
                    n, p = n + 1, q
            assert counts[i, k] == n


def test_texts_of_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    polish = "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw. Sa oni obdarzeni rozumem i sumieniem i powinni postepowac wobec innych w duchu braterstwa."
    finnish = "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto, ja heidan on toimittava toisiaan kohtaan veljeyden hengessa."
    foreign = [(-1, polish * 2), (-2, finnish * 3), (-3, "Все люди рождаются свободными и равными"), (-4, "7 8 9 ..."), (-5, None)]
    more = spark.createDataFrame([(i, t, None, "s", 1) for i, t in foreign], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(more), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_less_training_weighs_less():
    assert language.weights_of((("a", "x" * 30), ("b", "x" * 1022))).tolist() == [0.5, 1.0]


def test_held_out_accuracy(spark):
    got = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


# --- 7


def test_fingerprints_and_edits(spark):
    rows = [(5, "Hello  World"), (9, "hello world "), (2, None), (7, "ﬁne"), (1, "FINE"), (3, "x")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), parts=3).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[5].fingerprint == got[9].fingerprint and got[7].fingerprint == got[1].fingerprint and got[3].near_edited == 1.0
    assert fingerprint.shared_digests(spark.createDataFrame(rows, "doc_id bigint, text string")) == frozenset()


def test_colliding_digests_are_told_apart(spark):
    rows = [(1, "ab"), (2, "cd"), (3, "AB "), (4, "abc"), (None, "xy"), (None, "ab"), (5, "ad")]
    weak = lambda canon: str(len(canon))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert fingerprint.shared_digests(df, hasher=weak) == {"2"}
    got = fingerprint.fingerprints(df, parts=2, hasher=weak).collect()
    canon = {"ab": "ab", "cd": "cd", "AB ": "ab", "abc": "abc", "xy": "xy", "ad": "ad"}
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and len({of[i].fingerprint for i in of}) == len({canon[t] for i, t in rows if i is not None})
    assert of[1].fingerprint == of[3].fingerprint != of[2].fingerprint and of[4].fingerprint == "3"
    assert of[2].edited_fingerprint == "2-" + hashlib.sha256(b"ca").hexdigest() and of[1].near_next == 0.0
    assert sorted(r.edited_fingerprint for r in got if r.doc_id is None) == sorted("2-" + hashlib.sha256(x).hexdigest() for x in (b"aa", b"xa"))


# --- 8


def test_url_rules(spark):
    pages = [(1, "http://A.Example.NET/en/x?q"), (2, "http://net/"), (3, "http://net"), (4, "ftp://example.com/de/"), (5, "http://notexample.com/de/"), (6, "http://x.org/fr/#a"), (7, "nothing"), (8, None), (9, "http://spam-farm.org/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string"), [urls.host_rule(v, t) for v, t in urls.RULES] + [urls.label_rule("spam-farm")]).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("net", "/", "net/", "block") and got[3] == ("net", "", None, "allow")
    assert got[4] == ("example.com", "/de/", "example.com/de/", "block") and got[5] == ("notexample.com", "/de/", None, "allow") and got[6][2:] == ("org/fr/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][2:] == (None, "block")


# --- 9


def test_token_files(spark, tmp_path, odd_rows):
    from tokenizers import Tokenizer

    lib, out = Tokenizer.from_file(WORDS), f"file://{tmp_path}/tokens"
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 3] + [(-1, "of id minus one", "", "", 0), (-7, None, "", "", 0), (60_000, "again " * 4000, "", "", 0)] + [(50 + i, t, "", "", 0) for i, t in enumerate(["a​b c", "x<|endoftext|>y", "it's DON'T a.b 'so' don’t »a« a1b2 x.'s", "ΣΑΣ é"] + ["the cat sat on the mat again "] * 40)]
    tokens.write_tokens(spark.createDataFrame(rows, DOCS), out, WORDS, 49408, shard_chars=20_000)
    got, start = {r.doc_id: r for r in tokens.read_digests(spark, out, 49408).collect()}, 0
    ids_of = {}
    for i, t, *_ in sorted(rows):
        ids_of[i] = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids_of[i]), zlib.crc32(np.array(ids_of[i], "<u4").tobytes()))
        start += len(ids_of[i])
    for row in spark.read.parquet(out).collect():
        for k, i in enumerate(np.frombuffer(row.doc_ids, "<i8").tolist()):
            want = ids_of[i]
            a, b = len(want) // 3, len(want) - len(want) // 4
            assert row.without_id == 0
            assert tokens.read_range(row.rules, row.symbols, row.symbol_counts, 49408, k, a, b).tolist() == want[a:b]


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    lib, out = Tokenizer.from_file(WORDS), f"file://{tmp_path}/tokens"
    rows = [(None, "first of none"), (None, "second of none"), (None, None), (-1, "minus one"), (4, "one text"), (4, "and another text"), (4, "one text"), (9, "")]
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), out, WORDS, 49408)
    got = sorted(tokens.read_digests(spark, out, 49408).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, -1, 4, 4, 4, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((r.doc_id is None, r.ids_crc32) for r in got) == sorted((i is None, crc(t)) for i, t in rows)


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(5)
    for _ in range(40):
        n = int(r.integers(0, 300))
        symbols, run = r.integers(0, 4, n), np.sort(r.integers(0, 5, n))
        if r.random() < 0.3:
            symbols[:] = 1
        got, runs, rules = tokens.repair(symbols, run, np.ones(5, np.int64), 10, 3)
        flat, size = tokens.expansions(rules, 10)
        assert np.array_equal(tokens.spread(flat, size, got)[0], symbols)
        assert np.array_equal(np.repeat(runs, size[got]), run)
        pairs, k = {}, 0
        while k < len(got) - 1:  # a pair that overlaps itself counts every other time
            if runs[k] == runs[k + 1]:
                pairs[got[k], got[k + 1]] = pairs.get((got[k], got[k + 1]), 0) + 1
            k += 1
        assert all(n < 3 for (a, b), n in pairs.items() if a != b) and len(rules) < 100


# --- 10


def test_similar_lines_go(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(1, base + "\nshort line"), (2, base.upper() + "\nshort line\n" + base.replace("ten", "eleven")), (3, "one two three four five six x y z w"), (4, None), (5, "")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "short line", 3: rows[2][1], 4: None, 5: ""}


def test_crowded_keys_lose_no_line(spark, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", 3)
    r, words = random.Random(12), vocabulary(60)
    rows = []
    for _ in range(4):
        base = prose(r, words, 24).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(24)] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = [set(t.split()) for _, t in rows]
    want = {i for i in range(len(rows)) if any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))}
    got = {x.doc for x in lines.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and 10 < len(want) < len(rows)


@pytest.mark.parametrize("crowd", (512, 20))
def test_lines_that_are_alike_make_no_pairs_among_them(spark, monkeypatch, crowd):
    """A group of many near copies is compared once for each line, under crowded keys and under others."""
    monkeypatch.setattr(lines, "CROWD", crowd)
    compared, plain = [], lines._alike

    def counted(docs, pairs, *rest):
        compared.append(pairs.count())
        return plain(docs, pairs, *rest)

    monkeypatch.setattr(lines, "_alike", counted)
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join([*base[: i % 12], f"new{i}", *base[i % 12 :]])) for i in range(300)]
    got = {x.doc for x in lines.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == set(range(1, 300)) and sum(compared) < 300


def test_white_space_of_all_kinds_parts_tokens(spark):
    first = "one two three four five six seven eight nine ten"
    rows = [(1, first), (2, first.replace(" ", "\t", 3).replace(" ", "\x0b\f", 2)), (3, "\r" + first.replace(" ", " \r ") + "\f"), (4, " \t\r\f\x0b "), (5, " \t\r\f\x0b ")]
    got = {x.doc for x in lines.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), least=1).collect()}
    assert got == {2, 3}


@pytest.mark.parametrize("hot", (0, 3))
def test_lines_of_frequent_tokens_and_of_all_lengths(spark, monkeypatch, hot):
    """Keys by threes, by twos and one by one, with few and with many frequent tokens, on both sides of each length where they change."""
    monkeypatch.setattr(lines, "HOT", hot)
    r, words = random.Random(51 + hot), vocabulary(90)
    rows = []
    for n in (4, 6, 12, 17, 18, 19, 20, 21, 24, 50, 55, 60, 63, 64, 66, 70, 78):
        base = r.sample(words, n)
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randint(0, max(1, n // 7))):
                if r.random() < 0.5:
                    copy[r.randrange(len(copy))] = r.choice(words)
                else:
                    copy += r.sample(words, r.randint(0, n // 8))
            rows.append(" ".join(copy))
    r.shuffle(rows)
    sets = [set(t.split()) for t in rows]
    want = {i for i in range(len(rows)) if any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))}
    got = {x.doc for x in lines.removed_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), least=1).collect()}
    assert got == want and 20 < len(want) < len(rows) - 20


def test_keys_grow_no_faster_than_the_line(spark):
    r = random.Random(52)
    rows = [(i, " ".join(r.sample([f"w{k}" for k in range(24_000)], 20_000)) + f" only{i}") for i in range(2)]
    rows += [(2 + i, rows[1][1].replace("w7", "v7")) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = lines._places(df, "doc_id", "text", 1)
    slots = F.array_repeat(F.lit(lines.HOT << 40), lines.SLOTS)  # every token frequent
    assert max(x.n for x in lines._distinct_lines(placed, slots, 80).select(F.size("keys").alias("n")).collect()) <= 2 * 4002
    assert sorted((x.doc, list(x.removed)) for x in lines.removed_lines(df).collect()) == [(2, [0]), (3, [0])]


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    first, second = "a line that two rows have in common", "unique second line that nobody else has at all"
    rows = [(1, first), (2, "some other first line of five words\n" + second), (2, first + "\nanother unique line with words of its own"), (None, first), (2, first + "\nanother unique line with words of its own")]
    got = sorted(x.text for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([first, rows[1][1], "another unique line with words of its own", "another unique line with words of its own", first])


def test_short_lines_go_in_the_pipeline(spark):
    r = random.Random(33)
    # lines of one to six of eight words: equal ones, other orders and spaces, and sets of four inside sets of five
    texts = ["\n".join(r.choice((" ", "  ")).join(r.choice("abcdefgh") for _ in range(r.randint(0, 6))) for _ in range(6)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    met, want = [], {}
    for i, t in enumerate(texts):
        left = []
        for line in t.split("\n"):
            own = set(line.split())
            if not own or not any(100 * len(own & x) >= 80 * len(own | x) for x in met):
                left.append(line)
            if own:
                met.append(own)
        if "\n".join(left).strip(" "):
            want[i] = "\n".join(left)
    got = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert got == want and sum(map(len, want.values())) < sum(map(len, texts)) / 2


# --- pipeline


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns, name
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == {r.doc_id for r in kept.collect()} and all(r.round_trip for r in final.values())
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert not any(b in t for b in bench for t in texts.values())
    near = brute_components(list(texts.items()), 80)
    assert all(near[i][1] == i for i in texts)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, odd_rows, stage):
    name, run = corpus_pipeline.STAGES[stage]
    df = spark.createDataFrame(odd_rows, DOCS).withColumns({c: F.lit("clash") for c in ("id", "key", "line", "doc", "mark", "at", "same", "row")})
    got = run(spark, df, SF)
    rows = got.collect()
    assert (got.columns == df.columns) == (stage < 4)
    assert len(rows) == {"language_id": 10, "line_dedup": 12, "near_dedup": 12, "decontaminate": 16, "sentencepiece": 16}[name], [r.doc_id for r in rows]
    assert run(spark, df.limit(0), SF).count() == 0
