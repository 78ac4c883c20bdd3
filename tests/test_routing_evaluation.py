import random
import statistics

import pytest
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import scores as S
from sieveline.operators import evaluate as E
from sieveline.operators import routing as G
from sieveline.sources.rules import default_rules


def test_bands_at_their_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)], "p double")
    out = df.select(S.route_bands(F.col("p")).alias("a"), S.route_bands(F.col("p"), S.SEMANTIC_BANDS).alias("b")).collect()
    assert [r["a"]["decision"] for r in out] == ["OK", "OK", "AMBIGUOUS", "AMBIGUOUS", "FLAGGED", "FLAGGED", "FLAGGED"]
    assert [r["b"]["decision"] for r in out] == ["OK"] + ["AMBIGUOUS"] * 5 + ["FLAGGED"]
    assert (out[0]["a"]["confidence"], out[0]["b"]["confidence"]) == (90.0, 10.0)
    assert out[0]["a"]["action"] == fixed.RUNTIME_ACTIONS["OK"]


def test_cascade(spark):
    df = spark.createDataFrame(
        [(1, "  "), (2, "You BITCH"), (3, "hello"), (4, "bad"), (5, None)], "id int, comment_text string"
    )
    prob = F.when(F.col("id") == 4, 0.9).otherwise(0.1)
    reply = F.lit('{"reason_summary": "r", "risk_type": "insult", "recommended_action": "allow"}')
    nested = G.triage_columns(df, default_rules(), prob, reply=reply)
    rows = {r["id"]: r for r in G.flat_result(nested, "id").collect()}
    assert [rows[i]["final_decision"] for i in range(1, 6)] == ["OK", "FLAGGED", "OK", "FLAGGED", "OK"]
    assert [rows[i]["decided_by"] for i in (1, 2, 3)] == [fixed.DECIDED_BY_INPUT, fixed.DECIDED_BY_RULES, fixed.DECIDED_BY_MODEL]
    assert rows[2]["tier1_trigger"] == "bitch" and rows[2]["tier2_decision"] is None
    assert rows[4]["risk_type"] == "insult" and rows[3]["risk_type"] is None
    assert rows[1]["tier2_action"] == fixed.EMPTY_INPUT_ACTION and rows[1]["tier2_prob"] == 0.0

    seen = []

    def scorer(passed):
        seen.extend(r["id"] for r in passed.select("id").collect())
        return passed.withColumn("_p", prob)

    same = G.triage_cascade(df, default_rules(), scorer, reply=reply)
    assert sorted(seen) == [3, 4]
    assert sorted(map(str, G.flat_result(same, "id").collect())) == sorted(map(str, rows.values()))


def test_hybrid_scores_the_middle_band_only(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.5), (4, 0.9), (5, 0.95)], "id int, lr_prob double")
    seen = []

    def second(middle):
        seen.extend(r["id"] for r in middle.collect())
        return middle.withColumn("bert_prob", F.when(F.col("id") == 3, 0.81).otherwise(0.8))

    out = {r["id"]: r for r in G.hybrid_fallback(df, second, as_column=False).collect()}
    assert sorted(seen) == [2, 3, 4]
    assert [out[i]["y_pred"] for i in range(1, 6)] == [0, 0, 1, 0, 1]
    assert out[1]["bert_prob"] is None and out[2]["y_prob"] == 0.8
    column = G.hybrid_fallback(df, lambda needed: F.when(F.col("id") == 3, 0.81).otherwise(0.8))
    assert {r["id"]: r for r in column.collect()} == out
    assert {r["decision_source"]: r["percent"] for r in G.hybrid_breakdown(G.hybrid_fallback(df, second, as_column=False)).collect()} == {
        "lr_safe": 20.0, "lr_toxic": 20.0, "bert_fallback": 60.0
    }


@pytest.mark.parametrize(
    "reply, good",
    [
        ('{"reason_summary": "x", "risk_type": "pii", "recommended_action": "review"}', True),
        ('{"reason_summary": "x", "risk_type": "bad", "recommended_action": "review"}', False),
        ('{"reason_summary": "x", "risk_type": "pii", "recommended_action": "shout"}', False),
        ('{"reason_summary": "x", "risk_type": "pii"}', False),
        ('{"reason_summary": "x", "risk_type": "pii", "recommended_action": "review", "k": 1}', False),
        ('{"reason_summary": null, "risk_type": "pii", "recommended_action": "review"}', False),
        ("nope", False), (None, False), ("[1]", False),
    ],
)
def test_reason_replies(column, reply, good):
    (parsed,) = column(lambda c: G.parse_reason_json(c, F.lit("FLAGGED")), [reply])
    assert (parsed["risk_type"] == "pii") is good
    if not good:
        assert parsed.asDict() == fixed.REASON_FALLBACK
    assert column(lambda c: G.parse_reason_json(c, F.lit("OK")), [reply]) == [None]


def test_scores(spark):
    row = spark.range(1).select(
        S.softmax_scores(F.array(F.lit(1000.0), F.lit(1000.0)), ["Safe", "TOXIC"]).alias("s"),
        S.toxic_prob_from_scores(F.create_map(F.lit("neutral"), F.lit(0.3), F.lit("b"), F.lit(0.2))).alias("t"),
    ).first()
    assert row["s"] == {"safe": 0.5, "toxic": 0.5} and row["t"] == 0.7


def test_sweep_equals_brute_force_on_the_cut_offs(spark):
    rng = random.Random(1)
    probs = [i / 100 for i in range(0, 101)] + [rng.random() for _ in range(300)] + [i / 100.0 + 1e-16 for i in range(50, 91)]
    rows = [(p, int(rng.random() < p)) for p in probs]
    df = spark.createDataFrame(rows, "y_prob double, y_true int").repartition(5)
    got = {r["threshold"]: r for r in E.threshold_sweep(df).collect()}
    assert len(got) == 41
    for i in range(50, 91):
        flagged = [y for p, y in rows if p > i / 100.0]
        tp, positives = sum(flagged), sum(y for _, y in rows)
        r = got[round(i / 100, 2)]
        assert r["flagged_count"] == len(flagged)
        assert r["recall"] == pytest.approx(tp / positives, abs=1e-4)
        assert r["precision"] == pytest.approx(tp / len(flagged) if flagged else 0, abs=1e-4)
    best = E.best_threshold(E.threshold_sweep(df)).first()
    assert best["f1_score"] == max(r["f1_score"] for r in got.values())
    assert E.threshold_sweep(df.limit(0)).count() == 41


def test_metrics_with_empty_classes(spark):
    none = spark.createDataFrame([(0, 0)] * 3, "y_true int, y_pred int")
    assert E.binary_metrics(none).first().asDict() == {
        "tn": 3, "fp": 0, "fn": 0, "tp": 0, "accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1_score": 0.0
    }
    lines = {r["row"]: r for r in E.classification_report(none).collect()}
    assert lines["OK (0)"]["f1_score"] == 1.0 and lines["macro avg"]["f1_score"] == 0.5 and lines["weighted avg"]["f1_score"] == 1.0


def test_prob_stats_are_exact(spark):
    rng = random.Random(2)
    values = [round(rng.random(), 6) for _ in range(501)] + [0.5] * 400
    rows = [(v, "false_negative" if i % 3 else "false_positive") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "tier2_toxic_prob double, tier1_error_type string").repartition(4)
    got = {r["scope"]: r for r in E.prob_stats(df).collect()}
    for scope in ("overall", "false_negative", "false_positive"):
        part = [v for v, k in rows if scope in ("overall", k)]
        assert got[scope]["median"] == pytest.approx(statistics.median(part), abs=1e-4)
        assert got[scope]["std"] == pytest.approx(statistics.stdev(part), abs=1e-4)
        assert got[scope]["mean"] == pytest.approx(statistics.mean(part), abs=1e-4)


def test_route_names_the_model(spark):
    df = spark.createDataFrame([(0.1,), (None,)], "p double")
    assert [r["a"]["model_used"] for r in df.select(S.route_bands(F.col("p"), model="linear").alias("a")).collect()] == ["linear", "linear"]
    assert "model_used" not in df.select(S.route_bands(F.col("p")).alias("a")).first()["a"].asDict()
