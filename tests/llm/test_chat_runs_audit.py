"""Chat formatting, periodic runs and the filter audit against brute force and SQL, and on odd rows."""

import hashlib
import json
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from tidemark.llm import audit, chat, periodic
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op13_filter_audit"])
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


# --- chats


def test_control_strings_are_broken_and_come_back():
    r = random.Random(2)
    bits = [*chat.CONTROL, chat.MARK, "0", "1", "2", "\n", "<", "<|", "|>", "x", " ", "</", "s>", "[", "INST]"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        for role in (False, True):
            made = chat.escape(text, role)
            assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROL) and not (role and "\n" in made)


def test_paths_of_nested_schemas():
    assert chat.paths_of("OBJECT<LONG: STRING, STRING: OBJECT<`OBJECT<`: BIGINT>, `a b`: BIGINT, d: DECIMAL(2,1), v: VOID, `c.d`: OBJECT<e: ARRAY<VARIANT>, f: ARRAY<ARRAY<OBJECT<g: DOUBLE>>>>>") == [
        "LONG", "STRING.OBJECT<", "a b", "d", "c.d.e[]*", "c.d.f[][].g",
    ]
    assert chat.paths_of("BIGINT") == [""] and chat.paths_of("VOID") == []


RECORDS = [
    ('{"prompt": "p", "completion": "c", "meta": {"x": 1}}', [("user", "p"), ("assistant", "c")]),
    ('{"completion": "c", "system": "s", "prompt": "p"}', [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ('{"instruction": "i", "input": "n", "output": "o"}', [("user", "i\n\nn"), ("assistant", "o")]),
    ('{"instruction": "i", "input": "", "output": ""}', [("user", "i"), ("assistant", "")]),
    ('{"instruction": "i", "input": null, "output": "o"}', [("user", "i"), ("assistant", "o")]),
    ('{"question": "q", "context": "x", "answer": "a"}', [("user", "x\n\nq"), ("assistant", "a")]),
    ('{"messages": [{"role": "user", "content": "m"}, {"content": null, "role": "assistant", "id": 4}]}', [("user", "m"), ("assistant", "")]),
    ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}', [("user", "ab")]),
    ('{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]}', [("user", "h"), ("assistant", "g"), ("tool", "t")]),
    ('{"dialog": ["a", "b", "c"]}', [("user", "a"), ("assistant", "b"), ("user", "c")]),
]
UNKNOWN = ['{"prompt": "p"}', '{"prompt": "p", "completion": "c", "answer": "a"}', '{"messages": [{"role": "u", "content": "x"}, {"role": "u", "content": ["y"]}]}', "{", "", "5", None, "{}"]


def test_records_of_any_layout_become_turns(spark):
    rows = [(k, r) for k, (r, _) in enumerate(RECORDS)] + [(100 + k, r) for k, r in enumerate(UNKNOWN)]
    df = spark.createDataFrame(rows, "id long, record string").withColumns({"role": F.lit("clash"), "_place": F.lit(1), "conv_id": F.lit("clash")})
    turns, rest = chat.canonical_turns(df.select("id", "record", "role", "conv_id"))
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: want for k, (_, want) in enumerate(RECORDS)}
    assert sorted(r.id for r in rest.collect()) == [100 + k for k in range(len(UNKNOWN))]
    assert {r.layout for r in turns.collect()} == {"completion", "instruction", "answer", "messages", "parts", "shared", "dialog"}


def test_turn_records_carry_their_conversation(spark):
    rows = [json.dumps({"conv_id": c, "turn": t, "role": "user", "text": x}) for c, t, x in ((4, 1, "b"), (4, 0, "a"), (5, 0, None), (None, None, "n"))]
    turns, rest = chat.canonical_turns(spark.createDataFrame([(None, r) for r in rows], "id long, record string"))
    assert sorted((r.conv_id or -1, r.turn or 0, r.text) for r in turns.collect()) == [(-1, 0, "n"), (4, 0, "a"), (4, 1, "b"), (5, 0, "")] and rest.count() == 0


def test_formatted_chats_read_back(spark):
    r = random.Random(4)
    bits = [*chat.CONTROL, chat.MARK, "1", "word ", "\n", "é😀"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "odd\nrole", "<s>", None]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for c in (1, 2, None, 3) for t in range(40)]
    rows += [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (2, None, "assistant", "first"), (9, 0, "user", "x" * 5000)]
    turns = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit("clash"))
    for size in (50, 1_000_000):
        pieces = chat.format_chats(turns, size)
        got = {x.conv_id: x for x in chat.chat_digests(pieces).collect()}
        texts = {}
        for p in pieces.orderBy("conv_id", "piece").collect():
            texts.setdefault(p.conv_id, []).append(p)
        back = {}
        for t in chat.read_chats(pieces).orderBy("conv_id", "piece", "place").collect():
            back.setdefault(t.conv_id, []).append((t.role, t.text))
        key = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)  # noqa: E731  nulls first
        for conv in (1, 2, 3, None, 9):
            own = sorted((x[1:] for x in rows if x[0] == conv), key=key)
            want = [(role or "", text or "") for _, role, text in own]
            said = [x for role, x in want if role == "assistant"]
            assert back[conv] == want
            assert got[conv].n_turns == len(want) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
            assert got[conv].loss_chars == len("".join(said)) and got[conv].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
            assert got[conv].formatted_chars == sum(len(p.formatted) for p in texts[conv]) and (size == 50) == (len(texts[conv]) > 1) or conv == 9
            assert [p.last for p in texts[conv]] == [False] * (len(texts[conv]) - 1) + [True]
    assert chat.format_chats(turns.limit(0)).count() == 0 and chat.chat_digests(chat.format_chats(turns.limit(0))).count() == 0


# --- periodic runs


def runs_by_hand(words, shortest=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            a = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > a and i + p - a >= max(shortest, 2 * p):
                found.setdefault((a, i + p), p)
            i += i == a
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda x: (x[0], x[2]))


def test_extensions_in_the_grammar():
    r = np.random.default_rng(1)
    for kinds in (1, 2, 3, 20):
        s = np.concatenate([[1000], r.integers(0, kinds, 300), [1001]])
        g = periodic.Grammar(s)
        i, j = r.integers(1, 301, 500), r.integers(1, 301, 500)
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        for k, (ahead, back) in enumerate(zip(g.extend(i, j), g.extend(i, j, True), strict=True)):
            n = 0
            while s[i[k] + n] == s[j[k] + n]:
                n += 1
            m = 0
            while s[i[k] - 1 - m] == s[j[k] - 1 - m]:
                m += 1
            assert (ahead, back) == (n, m)


def test_runs_against_brute_force():
    r = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 5)):
            w = [str(r.randrange(r.choice([1, 2, 3, 30]))).encode() for _ in range(r.randint(0, 90))]
            if w and r.random() < 0.6:
                a, p = r.randrange(len(w)), r.randint(1, 9)
                w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < len(w) else x for i, x in enumerate(w)]
            texts.append(w)
        for shortest in (2, 12):
            for w, got in zip(texts, periodic.runs_of(texts, shortest), strict=True):
                assert [tuple(map(int, x)) for x in got] == runs_by_hand(w, shortest)


def row_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    return (
        len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest(),
    )


def test_every_document_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    r = random.Random(7)
    more = [(10_000 + k, " ".join(r.choice(["a", "b"]) for _ in range(r.randint(0, 200)))) for k in range(150)]
    more += [(20_000, None), (20_001, ""), (20_002, " \t\n "), (20_003, "x " * 11), (20_004, "x " * 12), (20_005, "é\x0bé\x0c" * 40), (20_004, "x " * 12)]
    both = docs.union(spark.createDataFrame(more, docs.schema)).withColumns({"runs": F.lit("clash"), "words": F.lit("clash")})
    monkeypatch.setattr("tidemark.tables.table", lambda *_: both)
    got = QUERIES["op12_periodic_runs"](spark, SF).collect()
    rows = both.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = {x.doc_id: row_by_hand(x.doc_id, x.text) for x in rows}
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in want) > 20
    for x in got:
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == want[x.doc_id]


def test_runs_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a " * 30), ("s", "b " * 5)], "doc_id string, text string")
    got = {x.doc_id: (x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic.periodic_runs(df).collect()}
    assert got == {None: (30, [(0, 30, 1)], "a"), "s": (5, [], "b b b b b")} and periodic.periodic_runs(df.limit(0)).count() == 0
    ids = df.select(F.lit(None).cast("bigint").alias("d"), "text")
    assert [x.t for x in ids.select(periodic.planted(F.col("d"), F.col("text")).alias("t")).collect()] == ["a " * 30, "b " * 5]


# --- audit


def test_lists_by_galloping():
    r = np.random.default_rng(0)
    for t in range(400):
        m = int(r.integers(1, 3000))
        a, b = np.unique(r.integers(0, m, int(r.integers(0, m + 1)))), np.unique(r.integers(0, m, int(r.integers(0, 60))))
        a, b = (b, a) if t % 2 else (a, b)
        assert np.array_equal(audit.places(a, b), np.searchsorted(b, a)) and np.array_equal(audit.union(a, b), np.union1d(a, b)) and np.array_equal(audit.holds(a, b), np.isin(a, b))


def test_words_in_pieces():
    r = random.Random(1)
    raw = "".join(r.choice("ab \t\n\x0b\x0c\r") for _ in range(5000)).encode()
    assert audit.words_of(raw, 64) == audit.words_of(raw) == (len(raw.split()), len(set(raw.split())))
    assert audit.words_of(b"x" * 500, 64) == (1, 1) and audit.words_of(b"") == (0, 0)


def test_audit_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    texts = [None, "", "A" * 50, "$", *(" ".join(r.choice(["ab", "CD", "e", "|", "longer", str(k)]) for k in range(r.choice([5, 99, 100, 150]))) for _ in range(40))]
    rows = [(r.randrange(60) if r.random() < 0.9 else None, r.choice(texts), r.choice(["en", "de", None])) for _ in range(300)] + [(5, texts[7], "en")] * 3 + [(1000, " ".join(map(str, range(200))), "all good")]
    labels = [(r.randrange(70), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit("clash"), "fails": F.lit(1), "digest": F.lit("clash")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    monkeypatch.setattr("tidemark.tables.table", lambda _, __, name: {"documents": docs, "labels": marks}[name])
    monkeypatch.setattr(audit, "BLOCK", 16)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failed = []
    for d, t, lang in rows:
        raw = t or ""
        w = raw.split()
        fails = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in raw) > 10 * len(raw), any(c in "#$%&*|" for c in raw), d is not None and first[raw] < d), strict=True) if x}
        failed.append((lang or "", fails, d in good and d is not None, d in toxic and d is not None))
    want, shapley = {}, {}
    for part in {p for p, *_ in failed}:
        own = [x for x in failed if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                want[part, "".join(order), k + 1] = [len(left), len(out), sum(f in x[1] for x in own) - len(out), sum(x[1] == {f} for x in own), sum(x[2] for x in out), sum(x[3] for x in out)]
                shapley[part, f] = shapley.get((part, f), 0) + len(out)
    got = QUERIES["op13_filter_audit"](spark, SF).collect()
    assert len(got) == len(want) == 4 * 600
    for x in got:
        key = (x.part, x.filter_order, x.step)
        assert [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost] == want[key] and x.shapley == shapley[x.part, x.filter_order[x.step - 1]]


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(audit.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
