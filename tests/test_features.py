import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import tokens
from sieveline.operators import features as X

WORDS = ["alpha", "beta", "gamma", "the", "of", "é", "naïve", "x", "of_course", "日本", "😀😁", "a.b", "!!"]


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in range(n)]


def py_word_terms(text, high, stop=()):
    import re

    toks = [t for t in re.findall(r"[^\W]{2,}", text.lower()) if t not in stop]
    return [" ".join(toks[i : i + n]) for n in range(1, high + 1) for i in range(len(toks) - n + 1)]


def py_char_terms(text, low, high):
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        if len(padded) <= low:
            out.append(padded)
            continue
        for n in range(low, high + 1):
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
            if n >= len(padded):
                break
    return out


def test_stop_words_are_sparks(spark):
    listed = StopWordsRemover.loadDefaultStopWords("english")
    assert sorted(fixed.STOP_WORDS) == sorted(w for w in listed if w.isalpha() and len(w) > 1)


def test_word_and_char_terms(column):
    texts = [t for _, t in corpus()]
    got = column(lambda c: tokens.word_ngrams(tokens.word_tokens(c, ["the"]), 1, 3), texts)
    assert got == [py_word_terms(t, 3, {"the"}) for t in texts]
    counted = column(lambda c: tokens.count_terms(tokens.word_ngrams(tokens.word_tokens(c, []), 1, 2)), texts)
    assert [{r["term"]: r["tf"] for r in row} for row in counted] == [dict(Counter(py_word_terms(t, 2))) for t in texts]
    words = ["a", "ab", "abcde", "😀😁x", "x" * 40]
    got = column(lambda c: tokens.word_char_ngrams(c, 3, 7), words)
    assert [sorted(g) for g in got] == [sorted(py_char_terms(w, 3, 7)) for w in words]


def brute_tfidf(rows, terms, spec):
    counts = {i: Counter(terms(t)) for i, t in rows}
    df, cf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        cf.update(c)
    n = len(rows)
    kept = [t for t in cf if spec.min_df <= df[t] <= spec.max_df * n]
    kept = sorted(sorted(kept, key=lambda t: (-cf[t], t.encode()))[: spec.max_features], key=str.encode)
    idx = {t: i for i, t in enumerate(kept)}
    out = {}
    for i, c in counts.items():
        w = {}
        for t, tf in c.items():
            if t in idx:
                w[t] = (1 + math.log(tf) if spec.sublinear else tf) * (math.log((1 + n) / (1 + df[t])) + 1)
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): (idx[t], round(v / norm, 9)) for t, v in w.items()})
    return out


def test_tfidf_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id int, comment_text string").repartition(3)
    for spec, terms in [
        (X.TfidfSpec("word", 1, 3, 40, min_df=2, stop_words=("the",)), lambda t: py_word_terms(t, 3, {"the"})),
        (X.TfidfSpec("word", 1, 2, 30, min_df=3, max_df=0.5, sublinear=True), lambda t: py_word_terms(t, 2)),
        (X.TfidfSpec("char", 3, 5, 50), lambda t: py_char_terms(t, 3, 5)),
        (X.TfidfSpec("char", 3, 4, 50, min_df=4, max_df=0.9), lambda t: py_char_terms(t, 3, 4)),
    ]:
        got = {(r["id"], r["term"]): (r["idx"], round(r["weight"], 9)) for r in X.tfidf(df, spec).collect()}
        assert got == brute_tfidf(rows, terms, spec)


def test_union_svd_and_projection(spark):
    df = spark.createDataFrame(corpus(), "id int, comment_text string")
    specs = [X.TfidfSpec("word", 1, 1, 9), X.TfidfSpec("char", 3, 3, 20)]
    vocabularies = [X.fit_vocabulary(df, s) for s in specs]
    blocks = [(X.tfidf(df, s, vocabulary=v), v.count()) for s, v in zip(specs, vocabularies)]
    width = sum(w for _, w in blocks)
    rows = X.sparse_rows(X.feature_union(blocks))
    dense = np.zeros((rows.count(), width))
    for r, row in enumerate(rows.orderBy("id").collect()):
        dense[r, row["indices"]] = row["values"]
    components, sigma = X.fit_svd(rows, width, 4)
    np.testing.assert_allclose(sigma, np.linalg.svd(dense, compute_uv=False)[:4], rtol=1e-6)
    np.testing.assert_allclose(components.T @ components, np.eye(4), atol=1e-8)
    projected = np.array([r["dense"] for r in X.svd_project(rows, components).orderBy("id").collect()])
    np.testing.assert_allclose(projected, dense @ components, atol=1e-9)


def test_embeddings_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus() + [(100, None), (101, "alpha beta"), (102, "alpha beta")], "id int, comment_text string")
    vectors = defaultdict(list)
    for parts in (1, 7):
        for r in X.embed_batch(df.repartition(parts), batch_size=5).collect():
            vectors[r["id"]].append(r["embedding"])
    assert all(a == b for a, b in vectors.values())
    assert vectors[101] == vectors[102]
    assert vectors[100][0] == [0.0] * 64
    assert abs(np.linalg.norm(vectors[101][0]) - 1) < 1e-6


def test_another_encoder_can_be_plugged_in(spark):
    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype="float32")

    df = spark.createDataFrame([(1, "aba"), (2, "")], "id int, comment_text string")
    got = {r["id"]: r["embedding"] for r in X.embed_batch(df, encoder=load).collect()}
    assert got == {1: [3.0, 2.0], 2: [0.0, 0.0]}


def test_encoder_batches_are_sorted_and_cut(spark):
    def load():
        # a batch tells the shortest and the longest of its texts
        return lambda texts: np.array([[min(map(len, texts)), max(map(len, texts)), len(t)] for t in texts], dtype="float32")

    rows = [(i, " ".join(["word"] * n)) for i, n in enumerate([40, 1, 39, 2, 38, 3, 37, 4])]
    df = spark.createDataFrame(rows, "id int, comment_text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in X.embed_batch(df, encoder=load, batch_size=4).collect()}
    assert sorted((v[0], v[1]) for v in got.values()) == [(4.0, 19.0)] * 4 + [(184.0, 199.0)] * 4
    cut = {r["id"]: r["embedding"][2] for r in X.embed_batch(df, encoder=load, batch_size=4, max_words=3).collect()}
    assert cut[1] == 4 and cut[3] == 9 and all(cut[i] in (14.0, 15.0) for i in (0, 2, 4, 5, 6, 7))
    texts = spark.createDataFrame([(" a  b\tc d",), ("",), ("a",)], "t string").select(X.first_words(F.col("t"), 3).alias("o"))
    assert [r["o"].rstrip() for r in texts.collect()] == [" a  b\tc", "", "a"]


def test_built_in_encoder_stays_in_the_jvm(spark):
    import hashlib

    texts = ["Alpha  beta\talpha", "", "é x", "one " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, comment_text string")
    out = X.embed_batch(df, dim=16)
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        v = np.zeros(16)
        for word in texts[r["id"]].lower().split():
            digest = hashlib.md5(word.encode()).hexdigest()
            v[int(digest[:8], 16) % 16] += 1 if int(digest[8], 16) < 8 else -1
        np.testing.assert_allclose(r["embedding"], v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_levels_find_the_same_vocabulary_with_fewer_terms(spark):
    """Pruned levels against counting everything, for several views at once."""
    rng = random.Random(7)
    name = lambda n: "".join(random.Random(n).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    pool = [name(int(rng.paretovariate(0.9))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(40)), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, comment_text string, g int").repartition(3)
    views = [[0, 1, 2], [0, 1], [0, 2], [1, 2]]
    n_docs = [sum(1 for r in rows if r[2] == g) for g in range(3)]
    for spec in (X.TfidfSpec("word", 1, 3, 60, min_df=2), X.TfidfSpec("word", 2, 3, 40, min_df=3, max_df=0.5), X.TfidfSpec("char", 3, 7, 50), X.TfidfSpec("char", 2, 3, 30, min_df=5, max_df=0.6)):
        tables = X.vocabulary_levels(df, spec, n_docs, views, group_col="g")
        whole = X.corpus_counts(df, spec).count()
        built = sum(t.count() for t in tables)
        if spec.min_df == 2 or spec == X.TfidfSpec("char", 3, 7, 50):
            assert built * 5 <= whole, (built, whole)
        for view in views:
            inside = df.filter(F.col("g").isin(*view))
            want = X.select_vocabulary(X.corpus_counts(inside, spec), F.lit(sum(n_docs[g] for g in view)), spec)
            got = X.view_vocabulary(tables, spec, n_docs, view)
            assert sorted((r["term"], r["cf"]) for r in got.collect()) == sorted((r["term"], r["cf"]) for r in want.collect())


def test_rank_is_cut(spark):
    """Of a matrix of rank 5 no noise becomes a component."""
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 30))
    rows = spark.createDataFrame([(list(range(30)), [float(x) for x in row]) for row in dense], "indices array<int>, values array<double>").repartition(3)
    components, sigma = X.fit_svd(rows, 30, 20)
    assert components.shape == (30, 5)
    np.testing.assert_allclose(sigma, np.linalg.svd(dense, compute_uv=False)[:5], rtol=1e-8)
