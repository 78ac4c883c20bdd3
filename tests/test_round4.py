import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sieveline.operators import features as X
from sieveline.operators import model as L
from sieveline.operators import solver

SPECS = (X.TfidfSpec("word", 1, 2, 40, sublinear=True), X.TfidfSpec("char", 3, 4, 60))


def messages():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i % 70, " ".join(rng.choice(words[: 2 + i % 5]) for _ in range(1 + i % 9)), i % 2 if i % 11 else None, i % 3) for i in range(140)]
    return [*rows, (200, None, 1, 0), (201, "", 0, 1), (202, "alpha " * 700, 1, 2), (None, "beta beta", 0, 0)]


def counted(spark):
    df = spark.createDataFrame(messages(), "id long, text string, y int, g int").repartition(3)
    vocabularies = [(spec, X.fit_vocabulary(df, spec, "text")) for spec in SPECS]
    fitted = [(spec, *X.fitted_terms(v, "term", "idf")) for spec, v in vocabularies]
    rows = df.select("id", "y", F.col("g").alias("group"), F.array().cast("array<double>").alias("dense"), "text")
    return df, vocabularies, fitted, X.packed_counts(rows, [(spec, terms) for spec, terms, _ in fitted])


def test_numbers_become_bytes_and_numbers_again():
    for numbers in ([], [0, 255, 256, -7, 70_000, 3], [5] * 300):
        made = X._coded(np.array(numbers, np.int64))
        assert X._decoded(memoryview(made)).tolist() == numbers
    assert len(X._coded(np.full(1000, 200))) == 1004


def test_packed_counts_are_the_union_of_the_weights(spark):
    df, vocabularies, fitted, packed = counted(spark)
    want, width = X.union_rows(df.withColumnRenamed("text", "comment_text"), vocabularies)
    found = X.weight_rows(packed.weighted([np.array(idf) for _, _, idf in fitted]))
    key = lambda rows: Counter((r["id"], tuple(r["indices"]), tuple(np.round(r["values"], 12))) for r in rows.collect())
    assert packed.width == width and key(found) == key(want)
    again, width = X.packed_union(df, vocabularies, "text")
    assert key(X.weight_rows(again)) == key(want) and packed.width == width and again.count() == len(messages())
    assert Counter(r["y"] for r in packed.classes([0, 2]).collect()) == Counter(y for _, _, y, g in messages() if g != 1 and y is not None)
    group = {(r["id"], r["comment_text"]): r["g"] for r in want.collect()}
    assert len({g for g in group.values()}) == 3
    frequencies = np.zeros((3, width))
    for r in want.collect():
        frequencies[r["g"], r["indices"]] += 1
    assert (packed.document_frequencies(3) == frequencies).all()


def test_passes_over_counts_equal_those_over_weights(spark):
    """Loss, gradient, curvature and the SVD's product, with rows of one group left out, rows without a class and a term of another view."""
    df, _, fitted, packed = counted(spark)
    idf = [np.array(i) for _, _, i in fitted]
    idf[0][1] = 0.0
    weights = {0: 0.7, 1: 1.9}
    inside = packed.weighted(idf, [0, 2], weights)
    dense = np.zeros((0, packed.width))
    y, weight = [], []
    for batch in inside.blocks.toArrow().to_batches():
        for entries, own, w in inside.parts(batch, "y", "weight"):
            block = np.zeros((entries.n, packed.width))
            block[entries.owner, entries.at] = entries.x
            dense, y, weight = np.vstack([dense, block]), [*y, *own], [*weight, *w]
    y, weight = np.array(y), np.array(weight)
    assert len(y) == sum(g != 1 for *_, g in messages()) and np.isclose(weight.sum(), sum(weights[c] for _, _, c, g in messages() if g != 1 and c is not None))
    assert (dense[:, 1] == 0).all()
    for b, start in ((0, 0), (1, packed.widths[0])):
        norms = (dense[:, start : start + packed.widths[b]] ** 2).sum(axis=1)
        assert np.allclose(norms[norms > 0], 1.0)
    w = np.random.default_rng(2).normal(size=packed.width + 2)
    z = dense @ w[: packed.width] + w[-2] + w[-1]
    sign = 2 * y - 1
    pull = -weight * sign / (1 + np.exp(sign * z))
    loss, gradient = solver.loss_and_gradient(_filled(inside), packed.width, 1, w)
    assert np.isclose(loss, (weight * np.logaddexp(0, -sign * z)).sum())
    np.testing.assert_allclose(gradient, [*(dense.T @ pull), pull.sum(), pull.sum()], atol=1e-10)
    np.testing.assert_allclose(solver.curvature(_filled(inside), packed.width, 1)[: packed.width], (weight / 4) @ dense**2, atol=1e-10)
    q = np.random.default_rng(3).normal(size=(packed.width, 5))
    np.testing.assert_allclose(X._gram_times(inside, q), dense.T @ (dense @ q), atol=1e-10)
    np.testing.assert_allclose(X._gram_times(inside, q.astype(np.float32)), dense.T @ (dense @ q), atol=1e-3)


def _filled(rows):
    """The same rows with a dense column of ones, also where the class is null."""

    given = rows.parts

    def parts(batch, *more):
        for entries, *rest in given(batch, *more):
            yield entries, np.ones(entries.n), *rest[1:]

    return X.Packed(rows.blocks, parts)


def test_a_fit_writes_counts_once_for_all_views(spark, monkeypatch):
    """No table of weights, for any fold: they were twelve bytes an entry, once as features and once packed."""
    df = spark.createDataFrame([(i, t, y or 0) for i, (_, t, y, _) in enumerate(messages())], "id long, comment_text string, y int")
    made, real = [], X.materialize
    look = lambda table, name: made.append(name) or real(table, name)
    monkeypatch.setattr(X, "materialize", look)
    monkeypatch.setattr(L, "materialize", look)
    out = L.oof_predictions(df, L.ModelSpec(blocks=SPECS, svd=5), 3).collect()
    assert sorted(r["id"] for r in out) == list(range(len(messages()))) and all(r["converged"] for r in out)
    assert made.count("counted") == 1 and not {"features", "packed"} & set(made)


def test_a_character_vocabulary_writes_no_counts(spark, monkeypatch):
    made, real = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda table, name: made.append(name) or real(table, name))
    df = spark.createDataFrame([(1, "abab"), (2, "ab"), (3, None)], "id long, comment_text string")
    found = {r["term"]: r["df"] for r in X.fit_vocabulary(df, X.TfidfSpec("char", 3, 3, 10)).collect()}
    assert found == {" ab": 2, "aba": 1, "bab": 1, "ab ": 2} and "counted" not in made


def test_directions_found_in_single_precision(spark, monkeypatch):
    """As good as those of double precision; where some values are far below the first, every pass but the first is in double precision."""
    rng = np.random.default_rng(9)
    kinds, real = [], X._gram_times
    monkeypatch.setattr(X, "_gram_times", lambda rows, q: kinds.append(q.dtype) or real(rows, q))
    full = rng.normal(size=(300, 40)) * np.logspace(0, -1, 40)
    low = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 40))
    for matrix, k, single in ((full, 6, 5), (low, 6, 1)):
        kinds.clear()
        rows = spark.createDataFrame([(list(range(40)), row.tolist()) for row in matrix], "indices array<int>, values array<double>").repartition(2)
        components, sigma = X.fit_svd(rows, 40, k, tol=0.0)
        want = np.linalg.svd(matrix, compute_uv=False)[: len(sigma)]
        np.testing.assert_allclose(sigma, want, rtol=1e-6)
        np.testing.assert_allclose(((matrix @ components) ** 2).sum(axis=0), sigma**2, rtol=1e-9)
        assert len(sigma) == (6 if matrix is full else 3) and kinds.count(np.dtype(np.float32)) == single and kinds[-1] == np.float64
