"""Decontamination against plain alignment of all pairs."""

import random

import numpy as np

from sieveline.llm import decontaminate as leak

D, I = "doc_id long, text string, similarity int", "item_id long, text string"


def plain(item, words):
    """Smith-Waterman by the book."""
    best, end, before = 0, 0, [0] * (len(words) + 1)
    for x in item:
        now = [0]
        for j, y in enumerate(words):
            now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
            if now[-1] > best or now[-1] == best and best and j + 1 < end:
                best, end = now[-1], j + 1
        before = now
    return best, end


def test_align_equals_plain():
    r = random.Random(0)
    for _ in range(200):
        a, b = [np.array([r.randrange(5) for _ in range(r.randint(1, 15))], np.int64) for _ in range(2)]
        assert leak.align(a, b) == plain(a.tolist(), b.tolist())


def case():
    r = random.Random(6)
    pool = [f"w{k}" for k in range(900)]
    common = ["the", "of", "and", "to"]
    text = lambda n: [r.choice(common) if r.random() < 0.4 else r.choice(pool) for _ in range(n)]
    items = [(i, text(r.randint(12, 40))) for i in range(25)]
    docs = []
    for d in range(300):
        words = text(r.randint(5, 200))
        if d % 3 == 0:
            copy = list(items[d % 25][1])
            for _ in range(d % 7):
                copy[r.randrange(len(copy))] = r.choice(pool)
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in copy]
        docs.append((d, " ".join(words), 0))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_equals_all_pairs(spark):
    docs, items = case()
    for settings in ({}, {"max_seeds": 90}):  # several passes
        out = leak.contaminated(spark.createDataFrame(docs, D).repartition(3), spark.createDataFrame(items, I), **settings).collect()
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in out}
        want = {}
        for d, t, _ in docs:
            for i, x in items:
                a, b = leak.hashes_of(leak.item_words(x)), leak.hashes_of(leak.item_words(t))
                best, _ = leak.align(a, b)
                if best / (2 * len(a)) >= 0.5:
                    want[d, i] = round(best / (2 * len(a)), 6)
        # a copy keeps a seed unless nearly every run of three words is edited
        assert set(got.items()) <= set(want.items()) and {k for k, v in want.items() if v >= 0.6} <= set(got) and len(got) >= 92
        words = {d: leak.item_words(t) for d, t, _ in docs}
        full = [r for r in out if r["similarity"] == 1]
        item = {i: leak.item_words(x) for i, x in items}
        assert full and all(words[r["doc_id"]][r["first_word"] : r["last_word"] + 1] == item[r["item_id"]] for r in full)


def test_edited_copies_whose_rare_runs_are_gone(spark):
    """Copies with every third or fourth word edited: the runs that survive are common or fewer than a quarter."""
    r = random.Random(11)
    items, docs = [], []
    for i in range(40):
        item = [f"i{i}w{k}" for k in range(12)]
        items.append((i, " ".join(item)))
        for times in range(i % 3):  # the verbatim item elsewhere makes the surviving runs the common ones
            docs.append((1000 + 10 * i + times, f"p{i} " + " ".join(item), 0))
        for k in r.sample(range(12), 3 + i % 2):
            item[k] = f"edit{i}x{k}"
        docs.append((i, f"before {i} " + " ".join(item) + " after", 0))
    for i in range(40, 48):  # no run of three survives the inserted words
        item = [f"i{i}w{k}" for k in range(20)]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(w for k, x in enumerate(item) for w in (x, f"new{i}x{k}")), 0))
    want = {}
    for d, t, _ in docs:
        for i, x in items:
            a, b = leak.hashes_of(leak.item_words(x)), leak.hashes_of(leak.item_words(t))
            best, _ = leak.align(a, b)
            if best / (2 * len(a)) >= 0.5:
                want[d, i] = best / (2 * len(a))
    out = leak.contaminated(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in out} == want and {(i, i) for i in range(40, 48)} <= set(want)


def test_equals_all_pairs_at_half(spark):
    docs, items = case()
    out = leak.contaminated(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out}
    want = {}
    for d, t, _ in docs:
        for i, x in items:
            a, b = leak.hashes_of(leak.item_words(x)), leak.hashes_of(leak.item_words(t))
            if (best := leak.align(a, b)[0]) >= len(a):
                want[d, i] = best / (2 * len(a))
    assert got == want and len(got) >= 95


def test_a_leak_in_every_document_is_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(i, f"x{i} y{i} {item} z{i}", 0) for i in range(200)], D)
    assert leak.contaminated(docs, spark.createDataFrame([(1, item), (2, "other words that are not in any document here")], I)).count() == 200


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b c d e f", 1), (3, "a b c d e f", 1), (None, "a b c d e f", 1), (4, "q " * 30_000 + "a b c d e f", 1)], D)
    items = spark.createDataFrame([(7, "A, b. c d e f"), (7, "A, b. c d e f"), (8, None), (9, "a b"), (None, "a b c d")], I)
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["first_word"], r["last_word"]) for r in leak.contaminated(docs, items).collect()) == [(3, 7, 1.0, 0, 5), (4, 7, 1.0, 30_000, 30_005)]
    assert leak.contaminated(docs.limit(0), items).count() == 0 and leak.contaminated(docs, items.limit(0)).count() == 0


def test_a_long_passage_of_a_longer_item_is_found(spark):
    words = [f"w{k}" for k in range(250)]
    docs = [(1, " ".join(["a", *words[100:200], "z"]), 0), (2, " ".join(words[:49]), 0), (3, " ".join(words[:50]), 0)]
    out = leak.contaminated(spark.createDataFrame(docs, D), spark.createDataFrame([(1, " ".join(words))], I)).collect()
    assert sorted((r["doc_id"], r["similarity"], r["first_word"], r["last_word"]) for r in out) == [(1, 0.4, 1, 100), (3, 0.2, 0, 49)]
