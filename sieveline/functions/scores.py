"""Probabilities, class scores and routing bands as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions.text import bind


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def linear_probability(features: Sequence[Column], weights: Sequence[float], intercept: float) -> Column:
    """Probability of a fixed linear model over a few columns."""
    logit = F.lit(float(intercept))
    for feature, weight in zip(features, weights, strict=True):
        logit = logit + feature * F.lit(float(weight))
    return sigmoid(logit)


def softmax_scores(logits: Column, labels: Sequence[str]) -> Column:
    """Logits to a ``label -> probability`` map; shifted by the maximum against overflow. Logits, powers and their sum are evaluated once."""
    names = F.array(*[F.lit(name.lower()) for name in labels])

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(powers, lambda x: x / t))

    def powers(logits: Column) -> Column:
        return bind(F.array_max(logits), lambda most: F.transform(logits, lambda x: F.exp(x - most)))

    return F.map_from_arrays(names, bind(bind(logits, powers), shares))


def _first_value(scores: Column, aliases: Sequence[str]) -> Column:
    """Value of the first key, in map order, that is one of the aliases."""
    hits = F.filter(F.map_entries(scores), lambda e: F.lower(e["key"]).isin(*aliases))
    return F.get(hits, F.lit(0))["value"]


def toxic_prob_from_scores(scores: Column) -> Column:
    """Toxic alias, else one minus the safe alias of a two-class map, else the largest, else 0."""
    return F.coalesce(
        _first_value(scores, fixed.TOXIC_ALIASES),
        F.when(F.size(scores) == 2, F.lit(1.0) - _first_value(scores, fixed.SAFE_ALIASES)),
        F.array_max(F.map_values(scores)),
        F.lit(0.0),
    )


def toxic_score_or_zero(scores: Column) -> Column:
    """The stricter variant: only the label ``toxic`` itself counts."""
    return F.coalesce(_first_value(scores, ["toxic"]), F.lit(0.0))


@dataclass(frozen=True)
class Bands:
    """Edges and texts of one routing. ``inclusive`` puts the upper edge itself into FLAGGED;
    ``confidence_in_decision`` reports 100(1-p) for OK instead of 100p."""

    safe: float
    toxic: float
    inclusive: bool
    confidence_in_decision: bool
    actions: dict[str, str]


RUNTIME_BANDS = Bands(0.35, 0.65, True, True, fixed.RUNTIME_ACTIONS)
SEMANTIC_BANDS = Bands(0.20, 0.80, False, False, fixed.SEMANTIC_ACTIONS)


def no_nan(prob: Column) -> Column:
    """Null in place of NaN, which Spark puts above every number."""
    return F.nanvl(prob.cast("double"), F.lit(None).cast("double"))


def band_decision(prob: Column, bands: Bands) -> Column:
    """A score that is null or not a number lies in no clear band and so in the middle one."""
    prob = no_nan(prob)
    flagged = prob >= bands.toxic if bands.inclusive else prob > bands.toxic
    return (
        F.when(prob < bands.safe, F.lit("OK")).when(flagged, F.lit("FLAGGED")).otherwise(F.lit("AMBIGUOUS"))
    )


def route_bands(prob: Column, bands: Bands = RUNTIME_BANDS, model: str | None = None) -> Column:
    """``struct(decision, confidence, toxic_prob, action)``, and ``model_used`` if the scorer's name is given."""
    decision = band_decision(prob, bands)
    sure = prob
    if bands.confidence_in_decision:
        sure = F.when(prob < bands.safe, F.lit(1.0) - prob).otherwise(prob)
    action = F.when(decision == "OK", F.lit(bands.actions["OK"]))
    for name in ("FLAGGED", "AMBIGUOUS"):
        action = action.when(decision == name, F.lit(bands.actions[name]))
    return F.struct(
        decision.alias("decision"),
        F.round(sure * 100, 2).alias("confidence"),
        F.round(prob, 6).alias("toxic_prob"),
        action.alias("action"),
        *([F.lit(model).alias("model_used")] if model is not None else []),
    )


def binary_target(label_columns: Sequence[str]) -> Column:
    columns = [F.col(name) for name in label_columns]
    return (F.greatest(*columns) if len(columns) > 1 else columns[0]).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 on an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def metric_columns(tn: Column, fp: Column, fn: Column, tp: Column, digits: int) -> list[Column]:
    total = tn + fp + fn + tp
    return [
        F.round(ratio(tp + tn, total), digits).alias("accuracy"),
        F.round(ratio(tp, tp + fp), digits).alias("precision"),
        F.round(ratio(tp, tp + fn), digits).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1_score"),
    ]


def confusion_counts(y_true: Column, y_pred: Column) -> list[Column]:
    return [
        F.count_if((y_true == 0) & (y_pred == 0)).alias("tn"),
        F.count_if((y_true == 0) & (y_pred == 1)).alias("fp"),
        F.count_if((y_true == 1) & (y_pred == 0)).alias("fn"),
        F.count_if((y_true == 1) & (y_pred == 1)).alias("tp"),
    ]
