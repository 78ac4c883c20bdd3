"""Null and NaN scores, repeated ids, replies that are nearly right, tables that are folders."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from sieveline.functions import scores
from sieveline.operators import evaluate, joins, routing
from sieveline.streaming import jobs

NAN = float("nan")


def test_null_and_nan_scores_lie_in_the_middle_band(spark):
    df = spark.createDataFrame([(1, None), (2, NAN), (3, 0.1), (4, 0.9)], "id int, p double")
    for bands in (scores.RUNTIME_BANDS, scores.SEMANTIC_BANDS):
        got = {r["id"]: r["d"] for r in df.select("id", scores.route_bands(F.col("p"), bands)["decision"].alias("d")).collect()}
        assert got == {1: "AMBIGUOUS", 2: "AMBIGUOUS", 3: "OK", 4: "FLAGGED"}


def test_both_hybrid_forms_keep_null_and_nan_scores(spark):
    df = spark.createDataFrame([(1, None), (2, NAN), (3, 0.01), (4, 0.99), (5, 0.5)], "id int, lr_prob double")
    column = routing.hybrid_fallback(df, lambda needed: F.lit(0.7))
    table = routing.hybrid_fallback(df, lambda rows: rows.withColumn("bert_prob", F.lit(0.7)), as_column=False)
    names = ["id", "bert_prob", "y_pred", "y_prob", "decision_source"]
    a, b = (sorted(map(tuple, x.select(names).collect())) for x in (column, table))
    assert a == b and [r[4] for r in a] == ["bert_fallback", "bert_fallback", "lr_safe", "lr_toxic", "bert_fallback"]


def test_sweep_flags_no_missing_score(spark):
    df = spark.createDataFrame([(1, None), (1, NAN), (0, None), (1, 0.99), (0, 0.2)], "y_true int, y_prob double")
    assert {r["flagged_count"] for r in evaluate.threshold_sweep(df).collect()} == {1}


def test_prob_stats_of_raw_values(spark):
    values = [0.00000049, 0.0000002, 0.3, 0.30000001, 0.30000002, 0.9, None, NAN]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.5)], "k string, p double")
    got = {r["scope"]: r for r in evaluate.prob_stats(df, "p", "k").collect()}
    real = [v for v in values if v is not None and not math.isnan(v)]
    assert got["a"]["n"] == 8 and got["a"]["median"] == round(statistics.median(real), 4) and got["a"]["min"] == 0.0
    assert got["a"]["std"] == round(statistics.stdev(real), 4) and got["b"]["std"] is None
    tiny = spark.createDataFrame([("c", 0.00049 + 1e-9 * k) for k in range(10)], "k string, p double")
    assert evaluate.prob_stats(tiny, "p", "k").filter("scope = 'c'").first()["median"] == 0.0005


@pytest.mark.parametrize("right,passed,differing", [([(1, 0), (1, 1), (2, 0)], True, 0), ([(1, 0), (1, 0), (2, 0)], False, 1), ([(1, 1), (1, 0), (2, 1)], False, 1)])
def test_integrity_of_repeated_ids(spark, right, passed, differing):
    left = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "id int, toxic int")
    row = joins.integrity_check(left, spark.createDataFrame(right, "id int, toxic int"), ["toxic"]).first()
    assert (row["passed"], row["mismatch_toxic"]) == (passed, differing)


def test_strict_replies(spark):
    good = '{"reason_summary": "x", "risk_type": "insult", "recommended_action": "review"}'
    bad = [good.replace('"x"', "5"), good.replace('"x"', '{"a": 1}'), good.replace('"x"', "null"), good + " more", good + good, "[" + good + "]", "", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate([good, *bad])], "i int, r string")
    got = dict(rows.select("i", routing.reason_is_valid(F.col("r"))).collect())
    assert got == {0: True} | {i + 1: False for i in range(len(bad))}


def test_stream_of_a_folder_a_file_and_nothing(spark, tmp_path):
    schema = "id bigint"
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "folder"))
    part = next((tmp_path / "folder").glob("*.parquet"))
    project = lambda df: df.filter("id >= 0")
    assert jobs.stream_project(spark, str(tmp_path / "folder"), schema, project, str(tmp_path / "o1"), str(tmp_path / "c1")).count() == 100
    one = jobs.stream_project(spark, str(part), schema, project, str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert one.count() == spark.read.parquet(str(part)).count()
    with pytest.raises(FileNotFoundError):
        jobs.stream_project(spark, str(tmp_path / "missing"), schema, project, str(tmp_path / "o3"), str(tmp_path / "c3"))


def test_goes_on_after_a_stop_between_batches(spark, tmp_path):
    spark.range(60).repartition(6).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    running = jobs.run_stream(jobs.message_stream(spark, str(tmp_path / "in"), "id bigint", max_files=1), out, state, once=False)
    while len([p for p in running.recentProgress if p["numInputRows"]]) < 2:
        assert running.isActive
    running.stop()
    done = jobs.stream_project(spark, str(tmp_path / "in"), "id bigint", lambda df: df, out, state, max_files=1)
    assert done.count() == 60 and done.distinct().count() == 60
