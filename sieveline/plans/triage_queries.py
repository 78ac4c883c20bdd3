"""Scores, routing, cascades, evaluation, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import scores as C
from sieveline.functions import text
from sieveline.operators import evaluate as E
from sieveline.operators import joins as J
from sieveline.operators import routing as G
from sieveline.operators import sampling as M
from sieveline.operators.reports import hybrid_report as build_hybrid_report
from sieveline.plans import fixtures as fx
from sieveline.plans import sql as S
from sieveline.plans.registry import query, table
from sieveline.session import materialize, scratch_path, ship_package
from sieveline.sources.rules import demo_rules
from sieveline.sources.tables import read_report, write_report
from sieveline.streaming import jobs

DOC_SCORE = S.score("comment_text", "id")
SCORED = f"{S.DOCS}, scored AS (SELECT *, {DOC_SCORE} AS p FROM docs)"


def scored_documents(spark, sf):
    return fx.documents(spark, sf).withColumn("p", fx.doc_score())


# ------------------------------------------------------------------ scores
@query("score_logreg", f"WITH {SCORED} SELECT id, p AS y_prob, CAST(p > 0.5 AS INTEGER) AS y_pred FROM scored")
def score_logreg(spark, sf):
    return scored_documents(spark, sf).select(
        "id", F.col("p").alias("y_prob"), (F.col("p") > 0.5).cast("int").alias("y_pred")
    )


_EXP = "exp(round(2 - 4 * p, 6) - greatest(round(2 - 4 * p, 6), round(4 * p - 2, 6)))"
_EXP2 = "exp(round(4 * p - 2, 6) - greatest(round(2 - 4 * p, 6), round(4 * p - 2, 6)))"


@query(
    "softmax_scores",
    f"WITH {SCORED}, e AS (SELECT id, {_EXP} AS a, {_EXP2} AS b FROM scored) SELECT id, round(a / (a + b), 6) AS non_toxic, "
    "round(b / (a + b), 6) AS toxic FROM e",
)
def softmax_scores(spark, sf):
    scores = C.softmax_scores(fx.logits(), ["Non-Toxic", "Toxic"])
    rounded = text.bind(scores, lambda s: F.struct(F.round(s["non-toxic"], 6).alias("non_toxic"), F.round(s["toxic"], 6).alias("toxic")))
    return fx.documents(spark, sf).select("id", F.inline(F.array(rounded)))


@query(
    "toxic_prob_from_scores",
    f"WITH {SCORED} SELECT id, p AS by_alias, round(1.0 - p, 6) AS by_safe_alias, greatest(p, 0.4, {S.second_score()}) AS by_maximum, "
    "CAST(0 AS DOUBLE) AS by_nothing, CAST(0 AS DOUBLE) AS strict FROM scored",
)
def toxic_prob_from_scores(spark, sf):
    p, second = F.col("p"), fx.second_score()

    def scores(*pairs):
        return F.create_map(*[F.lit(x) if isinstance(x, (str, float)) else x for pair in pairs for x in pair])

    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    three = scores(("insult", p), ("threat", 0.4), ("obscene", second))
    return scored_documents(spark, sf).select(
        "id",
        C.toxic_prob_from_scores(scores(("label_0", 0.1), ("LABEL_1", p))).alias("by_alias"),
        F.round(C.toxic_prob_from_scores(scores(("clean", p), ("rude", 0.3))), 6).alias("by_safe_alias"),
        C.toxic_prob_from_scores(three).alias("by_maximum"),
        C.toxic_prob_from_scores(nothing).alias("by_nothing"),
        C.toxic_score_or_zero(three).alias("strict"),
    )


# ------------------------------------------------------------------ routing
_RUNTIME = S.bands("p", 0.35, 0.65, True)
_SEMANTIC = S.bands("p", 0.2, 0.8, False)


@query(
    "route_bands",
    f"WITH {SCORED} SELECT id, {_RUNTIME} AS runtime_decision, round(CASE WHEN p < 0.35 THEN 1.0 - p ELSE p END * 100, 2) AS runtime_confidence, "
    f"{S.actions(_RUNTIME, fixed.RUNTIME_ACTIONS)} AS runtime_action, {_SEMANTIC} AS semantic_decision, round(p * 100, 2) AS semantic_confidence, "
    f"{S.actions(_SEMANTIC, fixed.SEMANTIC_ACTIONS)} AS semantic_action, round(p, 6) AS toxic_prob, 'linear' AS runtime_model_used FROM scored",
)
def route_bands(spark, sf):
    routed = scored_documents(spark, sf).select(
        "id", C.route_bands(F.col("p"), model="linear").alias("a"), C.route_bands(F.col("p"), C.SEMANTIC_BANDS).alias("b")
    )
    return routed.select(
        "id",
        *[F.col(f"{x}.{c}").alias(f"{n}_{c}") for x, n in (("a", "runtime"), ("b", "semantic")) for c in ("decision", "confidence", "action")],
        F.col("a.toxic_prob").alias("toxic_prob"), F.col("a.model_used").alias("runtime_model_used"),
    )


_HYBRID = (
    f"{S.LABELLED}, s AS (SELECT id, toxic AS y_true, {DOC_SCORE} AS lr_prob FROM labelled), "
    "k AS (SELECT *, CASE WHEN lr_prob < 0.3 THEN 'lr_safe' WHEN lr_prob > 0.9 THEN 'lr_toxic' ELSE 'bert_fallback' END AS decision_source FROM s), "
    f"b AS (SELECT *, CASE WHEN decision_source = 'bert_fallback' THEN {S.second_score()} END AS bert_prob FROM k), "
    "hybrid AS (SELECT id, y_true, lr_prob, bert_prob, CAST(CASE decision_source WHEN 'lr_safe' THEN 0 WHEN 'lr_toxic' THEN 1 "
    "ELSE CAST(bert_prob > 0.8 AS INTEGER) END AS INTEGER) AS y_pred, coalesce(bert_prob, lr_prob) AS y_prob, decision_source FROM b)"
)


def hybrid(spark, sf):
    first = fx.labelled(spark, sf).select("id", F.col("toxic").alias("y_true"), fx.doc_score().alias("lr_prob"))
    return G.hybrid_fallback(first, lambda needed: fx.second_score())


@query("hybrid_fallback", f"WITH {_HYBRID} SELECT * FROM hybrid")
def hybrid_fallback(spark, sf):
    return hybrid(spark, sf)


@query("hybrid_fallback_by_scorer", f"WITH {_HYBRID} SELECT * FROM hybrid")
def hybrid_fallback_by_scorer(spark, sf):
    """The second model as a table function: it gets the middle band alone."""
    first = fx.labelled(spark, sf).select("id", F.col("toxic").alias("y_true"), fx.doc_score().alias("lr_prob"))

    def second(middle):
        return middle.withColumn("bert_prob", fx.second_score())

    return G.hybrid_fallback(materialize(first, "first"), second, as_column=False)


@query(
    "hybrid_breakdown",
    f"WITH {_HYBRID}, c AS (SELECT count(*) AS n, count(*) FILTER (decision_source = 'lr_safe') AS a, "
    "count(*) FILTER (decision_source = 'lr_toxic') AS t, count(*) FILTER (decision_source = 'bert_fallback') AS b FROM hybrid), "
    "u AS (SELECT 'lr_safe' AS decision_source, a AS k, n FROM c UNION ALL SELECT 'lr_toxic', t, n FROM c UNION ALL SELECT 'bert_fallback', b, n FROM c) "
    "SELECT decision_source, k AS n, round(100.0 * k / n, 2) AS percent FROM u",
)
def hybrid_breakdown(spark, sf):
    return G.hybrid_breakdown(hybrid(spark, sf))


@query(
    "hybrid_report",
    f"WITH {_HYBRID}, c AS (SELECT count(*) AS n, count(*) FILTER (decision_source = 'lr_safe') AS a, "
    "count(*) FILTER (decision_source = 'lr_toxic') AS t, count(*) FILTER (decision_source = 'bert_fallback') AS b FROM hybrid), "
    "u AS (SELECT 'lr_safe' AS decision_source, a AS k, n FROM c UNION ALL SELECT 'lr_toxic', t, n FROM c UNION ALL SELECT 'bert_fallback', b, n FROM c) "
    f"SELECT n AS total_samples, decision_source, k AS n, round(100.0 * k / n, 2) AS percent, {fixed.HYBRID_SAFE}::DOUBLE AS safe_below, {fixed.HYBRID_TOXIC}::DOUBLE AS toxic_above FROM u",
)
def hybrid_report(spark, sf):
    """The report of the hybrid run, written as JSON, read back and flattened."""
    path = scratch_path(spark, "hybrid")
    report = build_hybrid_report(hybrid(spark, sf), "labels")
    write_report(report, path)
    again = read_report(spark, path, report.schema)
    return again.select("total_samples", F.inline("breakdown"), "thresholds.safe_below", "thresholds.toxic_above")


def _reply_sql() -> str:
    return f"list_extract({S.arr(fx.REPLIES)}, CAST(id % {len(fx.REPLIES)} AS INTEGER) + 1)"


def _reason_sql(reply: str, decision: str) -> str:
    """CTE-free columns of the parsed reason: only the first reply of the fixture is valid."""
    def item(key):
        return f"CASE WHEN json_valid({reply}) THEN json_extract_string({reply}, '$.{key}') END"

    valid = (
        f"coalesce(json_valid({reply}) AND len(json_keys(CASE WHEN json_valid({reply}) THEN {reply} END)) = 3 AND "
        f"{item('reason_summary')} IS NOT NULL AND {item('risk_type')} IN {S.ql(fixed.RISK_TYPES)} AND "
        f"{item('recommended_action')} IN {S.ql(fixed.REASON_ACTIONS)}, false)"
    )
    return ", ".join(
        f"CASE WHEN {decision} = 'FLAGGED' THEN CASE WHEN {valid} THEN {item(k)} ELSE {S.q(fixed.REASON_FALLBACK[k])} END END AS {k}"
        for k in fixed.REASON_KEYS
    )


@query(
    "parse_reason_json",
    f"WITH {SCORED}, r AS (SELECT id, {_RUNTIME} AS decision, {_reply_sql()} AS reply FROM scored) "
    f"SELECT id, decision, {_reason_sql('reply', 'decision')} FROM r",
)
def parse_reason_json(spark, sf):
    decided = scored_documents(spark, sf).select("id", C.band_decision(F.col("p"), C.RUNTIME_BANDS).alias("decision"))
    return decided.select("id", "decision", G.parse_reason_json(fx.reply(), F.col("decision")).alias("r")).select(
        "id", "decision", "r.*"
    )


def _cascade_sql(source: str, text_col: str, key: str, reply: str | None, keep: str = "id") -> str:
    """CTEs up to ``cascade``: the flattened result of the cascade over a source."""
    score = S.score(text_col, key)
    reason = (
        _reason_sql(reply, "tier2_decision") if reply else ", ".join(f"CAST(NULL AS VARCHAR) AS {k}" for k in fixed.REASON_KEYS)
    )
    return (
        f"{S.tier1_cte(source, text_col)}, c1 AS (SELECT *, nrm = '' AS empty, t_status = 'FLAGGED' AS hit, {score} AS p FROM t1), "
        f"c2 AS (SELECT *, CASE WHEN empty THEN 'OK' WHEN hit THEN NULL ELSE {_RUNTIME} END AS tier2_decision FROM c1), "
        f"cascade AS (SELECT {keep}, CASE WHEN hit THEN 'FLAGGED' ELSE tier2_decision END AS final_decision, "
        f"CASE WHEN empty THEN {S.q(fixed.DECIDED_BY_INPUT)} WHEN hit THEN {S.q(fixed.DECIDED_BY_RULES)} ELSE {S.q(fixed.DECIDED_BY_MODEL)} END AS decided_by, "
        "t_status AS tier1_status, t_reason AS tier1_reason, t_trigger AS tier1_trigger, tier2_decision, "
        "CASE WHEN empty THEN 0.0 WHEN NOT hit THEN round(p, 6) END AS tier2_prob, "
        "CASE WHEN empty THEN 0.0 WHEN NOT hit THEN round(CASE WHEN p < 0.35 THEN 1.0 - p ELSE p END * 100, 2) END AS tier2_confidence_pct, "
        f"CASE WHEN empty THEN {S.q(fixed.EMPTY_INPUT_ACTION)} WHEN NOT hit THEN {S.actions('tier2_decision', fixed.RUNTIME_ACTIONS)} END AS tier2_action, "
        f"{reason} FROM c2)"
    )


@query(
    "triage_cascade",
    f"WITH {S.NULL_MESSAGES}, {_cascade_sql('null_messages', 'comment_text', 'id', _reply_sql())} SELECT * FROM cascade",
)
def triage_cascade(spark, sf):
    triaged = G.triage_columns(
        fx.null_messages(spark, sf), demo_rules(), fx.doc_score(), reply=fx.reply()
    )
    return G.flat_result(triaged, "id")


@query(
    "triage_cascade_by_scorer",
    f"WITH {S.NULL_MESSAGES}, {_cascade_sql('null_messages', 'comment_text', 'id', None)} SELECT * FROM cascade",
)
def triage_cascade_by_scorer(spark, sf):
    """The same cascade with a scorer that is a table function, applied behind the rules only."""
    def scorer(df):
        return df.withColumn("_p", fx.doc_score())

    return G.flat_result(G.triage_cascade(fx.null_messages(spark, sf), demo_rules(), scorer), "id")


@query(
    "decision_distribution",
    f"WITH {S.DOCS}, {_cascade_sql('docs', 'comment_text', 'id', None)} "
    "SELECT final_decision, tier1_reason, count(*) AS n FROM cascade GROUP BY ALL",
)
def decision_distribution(spark, sf):
    triaged = G.triage_columns(fx.documents(spark, sf), demo_rules(), fx.doc_score())
    return E.decision_distribution(G.flat_result(triaged, "id"), "final_decision", "tier1_reason")


RULEORDER = [r for r in demo_rules() if not r.category.startswith("PII")]
_NO_PII = [r for r in fixed.DEFAULT_RULES + fixed.DEMO_RULES if not r["category"].startswith("PII")]


def _any_rule(rule) -> str:
    if rule["type"] == "lexicon":
        return f"len(list_filter({S.words('lower(comment_text)')}, lambda x: x IN {S.ql(rule['words'])})) > 0"
    return f"regexp_matches(lower(comment_text), {S.q(dict(S.REGEX_RULES)[rule['category']])})"


_CAUGHT = (
    f"{S.LABELLED}, v AS (SELECT id, toxic, {DOC_SCORE} AS p, ({' OR '.join(_any_rule(r) for r in _NO_PII)}) AS hit FROM labelled), "
    "caught AS (SELECT id, toxic AS true_label, CASE WHEN hit OR p >= 0.2 THEN 1 ELSE 0 END AS prediction, CASE WHEN hit THEN "
    f"{S.q(fixed.CAUGHT_BY_RULES)} WHEN p >= 0.2 THEN {S.q(fixed.CAUGHT_BY_MODEL)} ELSE {S.q(fixed.PASSED_BY_MODEL)} END AS caught_by FROM v)"
)


def caught(spark, sf):
    out = G.cascade_flagged_variant(fx.labelled(spark, sf), RULEORDER, fx.doc_score())
    return out.select("id", F.col("toxic").alias("true_label"), "prediction", "caught_by")


@query("cascade_flagged_variant", f"WITH {_CAUGHT} SELECT * FROM caught")
def cascade_flagged_variant(spark, sf):
    return caught(spark, sf)


@query("triage_distribution", f"WITH {_CAUGHT} SELECT caught_by, count(*) AS n FROM caught GROUP BY caught_by")
def triage_distribution(spark, sf):
    return E.decision_distribution(caught(spark, sf), "caught_by")


_SIM = (
    "sim AS (SELECT conv_id * 1000 + turn AS id, text AS comment_text, list_extract([' tier2', 'TIER1', ''], CAST(turn % 3 AS INTEGER) + 1) AS er, "
    "list_extract(['ok', 'FLAGGED', 'ok '], CAST(turn % 3 AS INTEGER) + 1) AS ed FROM conversations), "
    f"{_cascade_sql('sim', 'comment_text', 'id', _reply_sql(), 'id, comment_text, upper(trim(er)) AS expected_route, upper(trim(ed)) AS expected_decision')}, "
    "routed AS (SELECT *, CASE WHEN contains(lower(decided_by), 'tier 1') THEN 'TIER1' WHEN contains(lower(decided_by), 'tier 2') THEN 'TIER2' "
    "ELSE 'UNKNOWN' END AS actual_route FROM cascade), "
    "compared AS (SELECT id, comment_text, expected_route, actual_route, decided_by AS actual_route_raw, expected_decision, "
    "final_decision AS actual_decision, CAST(contains(actual_route, expected_route) AS INTEGER) AS route_match, "
    "CAST(expected_decision = final_decision AS INTEGER) AS decision_match, tier1_status, tier1_reason, tier1_trigger, tier2_decision, "
    "tier2_prob, tier2_confidence_pct, tier2_action, reason_summary, risk_type, recommended_action FROM routed)"
)


def simulated(spark, sf):
    triaged = G.triage_columns(fx.sim_inputs(spark, sf), demo_rules(), fx.doc_score(), reply=fx.reply())
    return G.simulation_compare(triaged)


@query("simulation_compare", f"WITH {_SIM} SELECT * FROM compared")
def simulation_compare(spark, sf):
    return simulated(spark, sf)


@query(
    "simulation_accuracy",
    f"WITH {_SIM} SELECT count(*) AS rows, round(avg(route_match), 4) AS route_accuracy, round(avg(decision_match), 4) AS decision_accuracy, "
    "count(*) FILTER (decision_match = 0) AS mismatches FROM compared",
)
def simulation_accuracy(spark, sf):
    return G.simulation_accuracy(simulated(spark, sf))


# ------------------------------------------------------------------ evaluation
@query("confusion_matrix", f"WITH {S.PREDICTIONS} SELECT {S.confusion('y_true', 'y_pred')} FROM preds")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(fx.predictions(spark, sf))


@query(
    "binary_metrics",
    f"WITH {S.PREDICTIONS}, c AS (SELECT {S.confusion('y_true', 'y_pred')} FROM preds) SELECT tn, fp, fn, tp, {S.metrics(4)} FROM c",
)
def binary_metrics(spark, sf):
    return E.binary_metrics(fx.predictions(spark, sf))


@query(
    "per_class_metrics",
    f"WITH {S.TIER1_LABELLED}, c AS (SELECT 'toxic' AS label, {S.confusion('toxic', 'tier1_pred')} FROM tl1 UNION ALL "
    f"SELECT 'low_quality', {S.confusion('low_quality', 'tier1_pred')} FROM tl1) SELECT label, tp + fn AS support_positive, tn + fp AS support_negative, "
    f"round(100.0 * (tp + fn) / (tn + fp + fn + tp), 4) AS positive_rate_pct, tn, fp, fn, tp, {S.metrics(6)} FROM c",
)
def per_class_metrics(spark, sf):
    return E.per_class_metrics(fx.tier1_labelled(spark, sf), fx.LABELS, "tier1_pred")


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


@query(
    "classification_report",
    f"WITH {S.PREDICTIONS}, c AS (SELECT {S.confusion('y_true', 'y_pred')} FROM preds), "
    f"k AS (SELECT 'OK (0)' AS row, {_ratio('tn', '(tn + fn)')} AS p, {_ratio('tn', '(tn + fp)')} AS r, {_ratio('2 * tn', '(2 * tn + fn + fp)')} AS f, tn + fp AS s FROM c "
    f"UNION ALL SELECT 'FLAGGED (1)', {_ratio('tp', '(tp + fp)')}, {_ratio('tp', '(tp + fn)')}, {_ratio('2 * tp', '(2 * tp + fp + fn)')}, tp + fn FROM c), "
    "u AS (SELECT * FROM k "
    f"UNION ALL SELECT 'accuracy', {_ratio('tp + tn', '(tn + fp + fn + tp)')}, {_ratio('tp + tn', '(tn + fp + fn + tp)')}, {_ratio('tp + tn', '(tn + fp + fn + tp)')}, tn + fp + fn + tp FROM c "
    "UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM k "
    "UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM k) "
    "SELECT row, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score, s AS support FROM u",
)
def classification_report(spark, sf):
    return E.classification_report(fx.predictions(spark, sf))


_SWEEP = (
    f"{S.PREDICTIONS}, cuts AS (SELECT unnest(range(50, 91)) AS i), "
    "flags AS (SELECT c.i, p.y_true, CAST(p.y_prob > c.i / 100.0 AS INTEGER) AS y_pred FROM cuts c CROSS JOIN preds p), "
    f"counted AS (SELECT i, {S.confusion('y_true', 'y_pred')} FROM flags GROUP BY i), "
    f"sweep AS (SELECT round(i / 100.0, 2) AS threshold, {S.metrics(4)}, tp + fp AS flagged_count FROM counted)"
)


def sweep(spark, sf):
    return E.threshold_sweep(fx.predictions(spark, sf))


@query("threshold_sweep", f"WITH {_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf):
    return sweep(spark, sf)


@query("best_threshold", f"WITH {_SWEEP} SELECT * FROM sweep ORDER BY f1_score DESC, precision DESC, accuracy DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return E.best_threshold(sweep(spark, sf))


@query("top_thresholds", f"WITH {_SWEEP} SELECT * FROM sweep ORDER BY f1_score DESC, threshold LIMIT 10")
def top_thresholds(spark, sf):
    return E.top_thresholds(sweep(spark, sf))


@query(
    "category_breakdown",
    f"WITH {S.TIER1_LABELLED} SELECT tier1_category, count(*) AS n FROM tl1 WHERE tier1_pred = 1 GROUP BY tier1_category",
)
def category_breakdown(spark, sf):
    return E.category_breakdown(fx.tier1_labelled(spark, sf))


@query(
    "error_analysis",
    f"WITH {S.TIER1_LABELLED}, fn AS (SELECT * FROM tl1 WHERE any_toxic = 1 AND tier1_pred = 0), fp AS (SELECT * FROM tl1 WHERE any_toxic = 0 AND tier1_pred = 1) "
    "SELECT 'false_negative' AS error_type, 'count' AS kind, '' AS item, count(*) AS n FROM fn UNION ALL SELECT 'false_positive', 'count', '', count(*) FROM fp "
    "UNION ALL SELECT 'false_negative', 'label', 'toxic', CAST(coalesce(sum(toxic), 0) AS BIGINT) FROM fn "
    "UNION ALL SELECT 'false_negative', 'label', 'low_quality', CAST(coalesce(sum(low_quality), 0) AS BIGINT) FROM fn "
    "UNION ALL SELECT 'false_positive', 'category', tier1_category, count(*) FROM fp GROUP BY tier1_category",
)
def error_analysis(spark, sf):
    return E.error_analysis(fx.tier1_labelled(spark, sf), fx.LABELS)


_ERRORS = (
    f"{S.TIER1_LABELLED}, errors AS (SELECT *, CASE WHEN any_toxic = 1 THEN 'false_negative' ELSE 'false_positive' END AS tier1_error_type, "
    f"{S.second_score()} AS tier2_toxic_prob FROM tl1 WHERE any_toxic <> tier1_pred)"
)


def errors(spark, sf):
    return J.tier1_errors(fx.tier1_labelled(spark, sf)).withColumn("tier2_toxic_prob", fx.second_score())


@query(
    "error_resolution",
    f"WITH {_ERRORS}, e AS (SELECT *, CAST(tier2_toxic_prob >= 0.8 AS INTEGER) AS pr FROM errors), "
    f"c AS (SELECT tier1_error_type, {S.confusion('any_toxic', 'pr')} FROM e GROUP BY 1) "
    "SELECT tier1_error_type, tn + fp + fn + tp AS total, tn + tp AS resolved, fp + fn AS unresolved, "
    f"round(100.0 * (tn + tp) / (tn + fp + fn + tp), 2) AS resolution_rate_pct, {S.metrics(6)} FROM c",
)
def error_resolution(spark, sf):
    return E.error_resolution(errors(spark, sf))


_STATS = (
    "count(*) AS n, round(avg(tier2_toxic_prob), 4) AS mean, round(quantile_cont(tier2_toxic_prob, 0.5), 4) AS median, "
    "round(stddev_samp(tier2_toxic_prob), 4) AS std, round(min(tier2_toxic_prob), 4) AS min, round(max(tier2_toxic_prob), 4) AS max"
)


@query(
    "prob_stats",
    f"WITH {_ERRORS} SELECT 'overall' AS scope, {_STATS} FROM errors UNION ALL SELECT tier1_error_type, {_STATS} FROM errors GROUP BY tier1_error_type",
)
def prob_stats(spark, sf):
    return E.prob_stats(errors(spark, sf))


@query(
    "residual_errors",
    f"WITH {_ERRORS} SELECT id, tier1_error_type, tier1_category, tier2_toxic_prob, substring(comment_text, 1, 200) AS example FROM errors "
    "WHERE (tier1_error_type = 'false_negative' AND tier2_toxic_prob < 0.8) OR (tier1_error_type = 'false_positive' AND tier2_toxic_prob >= 0.8)",
)
def residual_errors(spark, sf):
    return E.residual_errors(errors(spark, sf)).select(
        "id", "tier1_error_type", "tier1_category", "tier2_toxic_prob", F.substring("comment_text", 1, 200).alias("example")
    )


@query(
    "hard_examples",
    f"WITH {S.PREDICTIONS} SELECT id, y_true, y_pred, y_prob FROM preds WHERE y_true <> y_pred AND y_prob BETWEEN 0.40 AND 0.95",
)
def hard_examples(spark, sf):
    return E.hard_examples(fx.predictions(spark, sf)).select("id", "y_true", "y_pred", "y_prob")


@query(
    "hard_example_report",
    f"WITH {S.PREDICTIONS} SELECT 'test' AS source, count(*) AS rows_scored, count(*) FILTER (y_true <> y_pred AND y_prob BETWEEN 0.40 AND 0.95) "
    "AS hard_examples_found, CAST(0.4 AS DOUBLE) AS prob_min, CAST(0.95 AS DOUBLE) AS prob_max FROM preds",
)
def hard_example_report(spark, sf):
    return E.hard_example_report(fx.predictions(spark, sf), "test")


@query(
    "balanced_cascade_report",
    f"WITH {_CAUGHT}, r AS (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS rn FROM caught), "
    f"c AS (SELECT {S.confusion('true_label', 'prediction')} FROM r WHERE rn <= 500) SELECT tn, fp, fn, tp, {S.metrics(6)} FROM c",
)
def balanced_cascade_report(spark, sf):
    """The comparison run: a balanced sample through the two-way cascade, measured."""
    sample = M.balanced_sample(fx.labelled(spark, sf), "toxic", 500)
    judged = G.cascade_flagged_variant(sample, RULEORDER, fx.doc_score())
    return E.binary_metrics(judged, "toxic", "prediction", digits=6)


# ------------------------------------------------------------------ streaming
CONVERSATION_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _live(df):
    messages = df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("comment_text"))
    return G.flat_result(G.triage_columns(messages, demo_rules(), fx.doc_score()), "id")


_LIVE = "live AS (SELECT conv_id * 1000 + turn AS id, text AS comment_text FROM conversations)"


@query("stream_triage", f"WITH {_LIVE}, {_cascade_sql('live', 'comment_text', 'id', None)} SELECT * FROM cascade")
def stream_triage(spark, sf):
    """The cascade over conversations arriving as files, drained to a table."""
    base = scratch_path(spark, "stream")
    return jobs.stream_project(spark, f"{sf}/conversations.parquet", CONVERSATION_SCHEMA, _live, f"{base}/out", f"{base}/state")


@query("stream_triage_batch", f"WITH {_LIVE}, {_cascade_sql('live', 'comment_text', 'id', None)} SELECT * FROM cascade")
def stream_triage_batch(spark, sf):
    """What the stream must equal."""
    return _live(table(spark, sf, "conversations"))


def flagship(spark, sf):
    """Documents per decision and rule category."""
    ship_package(spark)
    return decision_distribution(spark, sf)
