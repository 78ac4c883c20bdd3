"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from sieveline.llm import neardup

S = "doc_id long, text string"


def truth(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(spark, rows, size):
    out = neardup.near_duplicates(spark.createDataFrame(rows, S).repartition(4), size=size).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}


def variants(seed, n_groups, copies, words, edits):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    rows, i = [], 100
    for _ in range(n_groups):
        base = [r.choice(pool) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(pool)
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,edits", [(2, 14), (5, 6)])
def test_equals_all_pairs(spark, size, edits):
    rows = variants(size, 12, 9, 90, edits)
    assert found(spark, rows, size) == truth(rows, size)


def test_links_beside_the_hub(spark):
    """Members that are linked with each other but not with the smallest id of their bucket."""
    base = [f"w{k}" for k in range(200)]

    def cut(start, end):
        return " ".join(base[start:end])

    rows = [(1, cut(0, 100)), (2, cut(11, 111)), (3, cut(22, 122)), (4, cut(33, 133)), (5, cut(60, 160)), (6, cut(62, 162)), (7, cut(71, 171))]
    assert found(spark, rows, 2) == truth(rows, 2)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\x0btwo"), (8, "É x"), (9, "é x"), (10, "a b " * 5000), (11, "a b " * 4999)]
    assert found(spark, rows, 2) == truth(rows, 2)
    df = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 2), (None, "a b c", 3)], "doc_id long, text string, component_id int")
    out = neardup.near_duplicates(df, size=2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0), (1, 1), (1, 1)]
    assert neardup.near_duplicates(df.limit(0), size=2).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(4)
    for n in (1, 2, 7, 300, 5000):
        whole = np.unique(r.integers(0, 2**63, n + n // 4 + 1, dtype=np.uint64))
        a, b = whole[:n], whole[n // 4 : n // 4 + n]
        x, y = neardup.sketch(a, 400), neardup.sketch(b, 400)
        assert x.max() < np.iinfo(np.uint64).max and (neardup.sketch(a[::-1].copy(), 400) == x).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - j) < 0.13


def test_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(90, 80), (85, 90), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {80: 80, 85: 80, 90: 80}


def test_an_id_with_several_texts_loses_no_link(spark):
    r = random.Random(9)
    one, two = ([f"{k}{r.randrange(900)}" for _ in range(60)] for k in "ab")
    near = list(two)
    near[30] = "changed"
    rows = [(5, " ".join(one)), (5, " ".join(two)), (9, " ".join(two)), (20, " ".join(near)), (21, " ".join(one)), (30, "quite another text")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, S), size=2).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in out) == [(5, 5), (5, 5), (9, 5), (20, 5), (21, 5), (30, 30)]


def test_bitmaps_never_refute_a_link(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    rows, want = [], []
    for _ in range(150):
        n, m, both = int(r.integers(1, 900)), int(r.integers(1, 900)), 0
        both = int(r.integers(0, min(n, m) + 1))
        whole = np.unique(r.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = whole[:n], np.concatenate([whole[:both], whole[n : n + m - both]])
        rows.append((neardup.bitmap(a).tolist(), neardup.bitmap(b).tolist(), len(a), len(b)))
        want.append(both)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a array<long>, b array<long>, n long, m long")
    got = {x["i"]: x["s"] for x in df.select("i", neardup.most_shared(F.col("a"), F.col("b"), F.col("n"), F.col("m")).alias("s")).collect()}
    assert all(got[i] >= w for i, w in enumerate(want))
    slack = [got[i] - w for i, (w, x) in enumerate(zip(want, rows)) if 0.8 < x[2] / x[3] < 1.25]
    assert np.mean(slack) < 60


def test_only_what_may_be_in_a_set_is_joined(spark):
    from sieveline.llm import filters

    df = spark.createDataFrame([(i, f"t{i}") for i in range(-500, 500)] + [(None, "n")], "id long, text string")
    known = filters.collect_filter(spark.createDataFrame([(i * 7,) for i in range(-20, 20)] * 3, "hash long"))
    may, other = filters.divided(df, "id", known)
    may, other = [r["id"] for r in may.collect()], [r["id"] for r in other.collect()]
    assert len(may) + len(other) == 1001 and None in other
    assert {i * 7 for i in range(-20, 20)} <= set(may) and len(may) < 100
    none = filters.collect_filter(spark.createDataFrame([], "hash long"))
    assert filters.divided(df, "id", none)[0].count() == 0 and filters.divided(df, "id", none)[1].count() == 1001


def test_texts_and_sketches_without_company_are_not_shuffled(spark, monkeypatch):
    sizes, split = [], neardup.divided

    def counting(df, column, known):
        out = split(df, column, known)
        sizes.append((column, "text" in df.columns, out[0].count()))
        return out

    monkeypatch.setattr(neardup, "divided", counting)
    r = random.Random(5)
    docs = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(40))) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " more") for i in range(5)] + [(2000, docs[7][1])]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - 1000 if 1000 <= i < 2000 else 7 if i == 2000 else i for i, _ in docs}
    assert ("node", False, 2) in sizes  # the two rows of one text
    assert [n for c, texts, n in sizes if texts] and all(n <= 30 for c, texts, n in sizes if texts)
    assert sum(n <= 40 for c, texts, n in sizes if c == "node" and not texts) == 2
