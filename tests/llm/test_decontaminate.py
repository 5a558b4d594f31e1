"""Leaks over whole documents, against brute force: items whose parts are far from each other, and items of few heavy words."""

import random

from tidemark.llm import decontaminate


def prose(r, words, n):
    return [r.choice(words) for _ in range(n)]


def by_brute_force(docs, items, percent=80):
    def runs(words, width):
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    found = set()
    for i, item in items:
        n, width = len(item), min(5, len(item))
        cut = n - max(5, n // 4) if n - max(5, n // 4) >= 5 else 0
        question, answer = runs(item[:cut], width), runs(item[cut:], width)
        for d, text in docs:
            own = runs(text, width)
            q, a = len(question & own), len(answer & own)
            if (q or a) and 100 * q >= percent * len(question) and 100 * a >= percent * len(answer):
                found.add((d, i, q, len(question), a, len(answer)))
    return found


def leaks_of(spark, docs, items):
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    kept = {x.doc_id for x in decontaminate.without_leaks(d, b).collect()}
    got = {tuple(x) for x in decontaminate.leaks(d, b).collect()}
    assert kept == {k for k, _ in docs} - {x[0] for x in got}
    return got


def test_parts_of_an_item_may_be_far_apart(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    item = prose(r, words, 60)
    docs = [(1, [*item[:32], *prose(r, words, 400), *item[28:]]), (2, [*item[:32], *prose(r, words, 400)]), (3, prose(r, words, 500))]
    assert leaks_of(spark, docs, [(9, item)]) == {(1, 9, 41, 41, 11, 11)}


def test_leaks_equal_brute_force_on_scattered_and_edited_items(spark):
    r = random.Random(6)
    common, rare = [f"c{k}" for k in range(40)], [f"r{k}" for k in range(5000)]
    items = [(k, [r.choice(rare if r.random() < 0.15 else common) for _ in range(r.randint(1, 70))]) for k in range(150)]
    docs = []
    for k in range(300):
        item = items[r.randrange(150)][1]
        at = sorted(r.sample(range(len(item) + 1), min(len(item) + 1, r.randint(0, 3))))
        parts = [item[max(0, a - r.choice((0, 4))) : b] for a, b in zip([0, *at], [*at, len(item)], strict=True)]
        r.shuffle(parts)
        text = prose(r, common, r.randint(0, 30))
        for part in parts:
            text += [r.choice(rare) if r.random() < 0.02 else w for w in part] + prose(r, common, r.choice((0, 5, 200)))
        docs.append((k, text))
    want = by_brute_force(docs, items)
    assert len({x[0] for x in want}) > 60 and any(len(docs[x[0]][1]) > 200 for x in want)
    assert leaks_of(spark, docs, items) == want


def test_the_heaviest_words_of_an_item_may_be_missing(spark):
    """An item of common words with rare ones at its beginning, which are most of its score."""
    r = random.Random(7)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(7)]
    item = rare + [common[k % 30] for k in range(53)]
    others = [(k, r.sample(common, 25)) for k in range(40)]
    docs = [(1, item[7:]), (2, item[20:])]
    got = leaks_of(spark, docs, [(99, item), *others])
    assert got == by_brute_force(docs, [(99, item), *others]) and (1, 99) in {x[:2] for x in got}
