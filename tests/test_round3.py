"""Models of words alone, tables of many files and rows, repeated ids of character n-grams."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sieveline.functions import scores as C
from sieveline.operators import features as X
from sieveline.operators import model as L
from sieveline.operators import solver
from sieveline.plans import feature_queries as Q


def test_model_of_words_alone_scores(spark):
    df = spark.createDataFrame(list(enumerate(["aa bb cc aa", "bb cc dd", None, ""])), "id long, comment_text string").repartition(3)
    for spec in (X.TfidfSpec("word", 1, 2, 100, sublinear=True), X.TfidfSpec("word", 1, 2, 100), X.TfidfSpec("word", 2, 2, 100)):
        vocabulary = X.fit_vocabulary(df, spec).withColumn("coef", F.lit(1.0))
        model = L.TriageModel(L.ModelSpec(blocks=(spec,), svd=None), [vocabulary], 0.5, [], 0.0)
        got = {r["id"]: r["y_prob"] for r in model.score_rows(df).collect()}
        assert len(got) == 4 and got[2] == got[3] < min(got[0], got[1])


def test_character_counts_of_repeated_and_null_ids(spark):
    rows = [(1, "ab ab"), (2, "Abc x"), (2, "abc"), (None, "abc"), (None, "ab"), (3, None), (4, " ")]
    df = spark.createDataFrame(rows, "id long, comment_text string").repartition(4)
    spec, want = X.TfidfSpec("char", 4, 5, 100), Counter()
    for i, text in rows:
        for word in (text or "").lower().split():
            padded = f" {word} "
            grams = [padded[k : k + n] for n in (4, 5) for k in range(len(padded) - n + 1)] or [padded]
            for g in grams:
                want[i, g] += 1
    got = [(r["id"], r["term"], r["tf"]) for r in X.term_counts(df, spec).collect()]
    assert len(got) == len(want) and {(i, t): n for i, t, n in got} == want


def test_character_counts_of_single_ids_are_not_shuffled(spark):
    df = spark.range(300).select("id", F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(5)]).alias("comment_text")).repartition(4)
    plan = X.term_counts(df, X.CHAR_SPEC).filter("tf > 0")._jdf.queryExecution().optimizedPlan().toString()
    above_text = plan.split("MapInArrow")[0]
    assert "Union" in above_text and "Aggregate" not in above_text.split("Union")[0]


def test_levels_hold_few_terms_at_once(spark, monkeypatch):
    monkeypatch.setattr(X, "HELD", 10)
    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}x" for k in range(30))) for i in range(60)], "id long, comment_text string").repartition(2)
    for spec in (X.TfidfSpec("word", 1, 3, 40, min_df=2), X.TfidfSpec("char", 3, 5, 40)):
        n, chosen = X._chosen(df, spec, "comment_text")
        want = X.select_vocabulary(X.corpus_counts(df, spec), F.lit(n), spec)
        assert sorted((r["term"], r["cf"]) for r in chosen.collect()) == sorted((r["term"], r["cf"]) for r in want.collect())


def test_a_batch_of_the_embedding_job_holds_many_files(spark, tmp_path, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(6).cast("long").alias("n_chars"))
    docs.repartition(8).write.option("maxRecordsPerFile", 10).parquet(f"{tmp_path}/documents.parquet")
    asked, real = [], Q.jobs.stream_project

    def seen(*args, max_files=None, **more):
        asked.append(max_files)
        return real(*args, max_files=max_files, **more)

    monkeypatch.setattr(Q.jobs, "stream_project", seen)
    row = Q.resumable_embedding(spark, str(tmp_path)).first()
    assert row["broke_between_batches"] and row["rows_after_rerun"] == 400 and row["differing"] == 0
    assert min(asked) > 1


def test_softmax_evaluates_its_logits_once(spark):
    """The logits of a text are a chain of regular expressions: they stand in the plan once, and the shares are as before."""
    logits = F.transform(F.array(F.lit(1.0), F.lit(-1.0)), lambda x: x * F.sqrt("x"))
    df = spark.createDataFrame([(4.0,), (0.0,), (None,), (1e6,)], "x double")
    scores = df.select("x", C.softmax_scores(logits, ["A", "b"]).alias("s"))
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("SQRT") == 1
    for r in scores.collect():
        if r["x"] is None:
            assert r["s"] == {"a": None, "b": None}
        else:
            a = 1 / (1 + math.exp(-2 * math.sqrt(r["x"]))) if r["x"] < 1e6 else 1.0
            assert abs(r["s"]["a"] - a) < 1e-12 and abs(r["s"]["a"] + r["s"]["b"] - 1) < 1e-12


def test_tokens_are_found_once_for_all_levels(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"aa bb c{i % 3}c dd") for i in range(30)], "id long, comment_text string")
    made, real = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, name: made.append(name) or real(df, name))
    tables = X.vocabulary_levels(df, X.TfidfSpec("word", 1, 4, 50), [30], [[0]])
    assert made.count("tokens") == 1 and len(tables) == 4
    four = {r["term"]: (r["cf"][0], r["df"][0]) for r in tables[3].collect()}  # a number holds three tokens, so these take two
    assert four == {f"aa bb c{k}c dd": (10, 10) for k in range(3)}


def test_packed_rows_are_the_rows(spark):
    rows = [([0, 3], [1.5, -2.0], [1.0, 2.0], 1), ([], [], [0.0, 4.0], 0), ([2], [7.0], [5.0, 6.0], 1)]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>, dense array<double>, y int").coalesce(1)
    (batch,) = X.packed(df, "dense", "y").toArrow().to_batches()
    ((n, owner, at, x, dense, y),) = X.unpacked(batch, "dense", "y")
    assert (n, owner.tolist(), at.tolist(), x.tolist()) == (3, [0, 0, 2], [0, 3, 2], [1.5, -2.0, 7.0])
    assert dense.tolist() == [1.0, 2.0, 0.0, 4.0, 5.0, 6.0] and y.tolist() == [1.0, 0.0, 1.0]


def test_guess_along_the_components_saves_steps(spark):
    """With components and their singular values the solver reaches the same optimum in fewer steps."""
    rng = np.random.default_rng(4)
    n, width, r = 400, 60, 8
    x = rng.normal(size=(n, r)) @ rng.normal(size=(r, width)) * 3 + 0.05 * rng.normal(size=(n, width))
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    _, sigma, turned = np.linalg.svd(x, full_matrices=False)
    basis, sigma = turned[:r].T, sigma[:r]
    df = spark.createDataFrame([(list(range(width)), row.tolist(), [], int(t), 1.0) for row, t in zip(x, y)], "indices array<int>, values array<double>, dense array<double>, y int, weight double").repartition(2)
    with_guess, without = (solver.solve(df, width, 0, float(n), basis, tol=1e-8, sigma=s) for s in (sigma, None))
    assert with_guess.converged and without.converged and with_guess.iterations < without.iterations
    np.testing.assert_allclose(with_guess.coefficients, without.coefficients, atol=1e-4)


def test_packed_blocks_are_multiplied_together(spark, monkeypatch):
    r = np.random.default_rng(5)
    matrix = np.where(r.random((3000, 60)) < r.random(60) ** 3, r.random((3000, 60)), 0.0)
    matrix[1700:2100] = 0.0
    data = [([int(i) for i in np.flatnonzero(row)], [float(v) for v in row[row != 0]]) for row in matrix]
    rows = X.packed(spark.createDataFrame(data, "indices array<int>, values array<double>").coalesce(1))
    q = r.normal(size=(60, 7))
    assert np.allclose(X._gram_times(rows, q), matrix.T @ (matrix @ q), rtol=1e-12, atol=1e-9)
    blocks = [block for batch in rows.toArrow().to_batches() for block in X.unpacked(batch)]
    found = list(X.joined(iter(blocks), X.ROWS))
    assert [n for n, *_ in found] == [1024, 1024, 952] and sum(n for n, *_ in blocks) == 3000
    assert all((np.diff(owner) >= 0).all() and (not len(owner) or owner[-1] < n) for n, owner, *_ in found)
    assert np.isclose(sum(x.sum() for *_, x in found), matrix.sum())
    assert list(X.joined(iter([]), 5)) == []
