"""Confusion counts, metrics, threshold sweeps and error analysis.

Every metric comes from counts. A table is read once; what leaves the map side is a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import scores as S


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*S.confusion_counts(F.col(y_true), F.col(y_pred)))


def _metrics(digits: int) -> list[Column]:
    return S.metric_columns(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"), digits)


def binary_metrics(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", digits: int = 4, by: Sequence[str] = ()
) -> DataFrame:
    counts = confusion_matrix(df, y_true, y_pred, by)
    return counts.select(*by, "tn", "fp", "fn", "tp", *_metrics(digits))


def per_class_metrics(df: DataFrame, labels: Sequence[str], y_pred: str = "y_pred", digits: int = 6) -> DataFrame:
    """One prediction measured against each label. Four counters per label in a single aggregate,
    instead of one copy of the table per label."""
    cells = ["tn", "fp", "fn", "tp"]
    sums = [
        count.alias(f"{name}_{cell}")
        for name in labels
        for cell, count in zip(cells, S.confusion_counts(F.col(name), F.col(y_pred)))
    ]
    items = F.array(
        *[
            F.struct(F.lit(name).alias("label"), *[F.col(f"{name}_{cell}").alias(cell) for cell in cells])
            for name in labels
        ]
    )
    out = df.agg(*sums).select(F.inline(items))
    positive, negative = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return out.select(
        "label", positive.alias("support_positive"), negative.alias("support_negative"),
        F.round(100 * S.ratio(positive, positive + negative), 4).alias("positive_rate_pct"),
        "tn", "fp", "fn", "tp", *_metrics(digits),
    )


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", digits: int = 4) -> DataFrame:
    """Both classes, accuracy, macro and weighted averages, from one set of confusion counts."""
    c = {name: F.col(name) for name in ("tn", "fp", "fn", "tp")}

    def line(name, hits, predicted, support):
        return F.struct(
            F.lit(name).alias("row"),
            S.ratio(hits, predicted).alias("precision"), S.ratio(hits, support).alias("recall"),
            S.ratio(2 * hits, predicted + support).alias("f1_score"), support.alias("support"),
        )

    n = c["tn"] + c["fp"] + c["fn"] + c["tp"]
    counts = confusion_matrix(df, y_true, y_pred).select(
        line("OK (0)", c["tn"], c["tn"] + c["fn"], c["tn"] + c["fp"]).alias("ok"),
        line("FLAGGED (1)", c["tp"], c["tp"] + c["fp"], c["tp"] + c["fn"]).alias("flagged"),
        n.alias("n"), S.ratio(c["tp"] + c["tn"], n).alias("acc"),
    )
    ok, flagged = F.col("ok"), F.col("flagged")
    measures = ("precision", "recall", "f1_score")

    def average(name, weigh):
        return F.struct(F.lit(name).alias("row"), *[weigh(m).alias(m) for m in measures], F.col("n").alias("support"))

    rows = F.array(
        ok,
        flagged,
        average("accuracy", lambda m: F.col("acc")),
        average("macro avg", lambda m: (ok[m] + flagged[m]) / 2),
        average("weighted avg", lambda m: S.ratio(ok[m] * ok["support"] + flagged[m] * flagged["support"], F.col("n"))),
    )
    return counts.select(F.inline(rows)).select("row", *[F.round(m, digits).alias(m) for m in measures], "support")


def _passed_cutoffs(prob: Column, low: int, high: int) -> Column:
    """The largest ``i`` in ``low..high`` with ``prob > i / 100``; ``low - 1`` if none.

    A first guess by rounding, then put right by the very comparison that defines the sweep, so
    that scores lying on a cut-off fall on the correct side. A score that is null or not a number passes no cut-off.
    """
    prob = S.no_nan(prob)
    guess = F.ceil(prob * 100) - 1
    up = F.when(prob > (guess + 1) / F.lit(100.0), guess + 1)
    down = F.when(prob > guess / F.lit(100.0), guess)
    exact = F.coalesce(up, down, guess - 1)
    within = F.greatest(F.least(exact, F.lit(high)), F.lit(low - 1)).cast("int")
    return F.when(prob.isNull(), F.lit(low - 1)).otherwise(within)


def threshold_sweep(
    df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", low: int = 50, high: int = 90, digits: int = 4
) -> DataFrame:
    """Metrics at every cut-off ``low/100 .. high/100``.

    A histogram over the cut-offs (at most ``high - low + 2`` rows) and sums from the top replace
    one pass per cut-off.
    """
    cuts = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("_i"))
    histogram = (
        df.select(_passed_cutoffs(F.col(y_prob), low, high).alias("_i"), F.col(y_true).alias("_y"))
        .groupBy("_i")
        .agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg"))
    )
    zero = F.lit(0).cast("long")
    steps = histogram.unionByName(cuts.select("_i", zero.alias("_pos"), zero.alias("_neg")))
    steps = steps.groupBy("_i").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    above = W.orderBy(F.desc("_i"))
    everything = W.partitionBy()
    summed = steps.select(
        "_i",
        F.sum("_pos").over(above).alias("tp"), F.sum("_neg").over(above).alias("fp"),
        F.sum("_pos").over(everything).alias("_p"), F.sum("_neg").over(everything).alias("_n"),
    ).filter(F.col("_i") >= low)
    counts = summed.select(
        F.round(F.col("_i") / 100.0, 2).alias("threshold"), "tp", "fp",
        (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"),
    )
    return counts.select("threshold", *_metrics(digits), (F.col("tp") + F.col("fp")).alias("flagged_count"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1_score"), F.desc("precision"), F.desc("accuracy"), "threshold").limit(1)


def top_thresholds(sweep: DataFrame, k: int = 10) -> DataFrame:
    return sweep.orderBy(F.desc("f1_score"), "threshold").limit(k)


def category_breakdown(df: DataFrame, pred: str = "tier1_pred", category: str = "tier1_category") -> DataFrame:
    return df.filter(F.col(pred) == 1).groupBy(category).agg(F.count("*").alias("n"))


def error_analysis(
    df: DataFrame, labels: Sequence[str], y_true: str = "any_toxic", pred: str = "tier1_pred", category: str = "tier1_category"
) -> DataFrame:
    """``(error_type, kind, item, n)``: totals, the labels behind the misses and the categories
    behind the false alarms."""
    missed = (F.col(y_true) == 1) & (F.col(pred) == 0)
    alarm = (F.col(y_true) == 0) & (F.col(pred) == 1)
    sums = df.agg(
        F.count_if(missed).alias("_fn"), F.count_if(alarm).alias("_fp"),
        *[F.coalesce(F.sum(F.when(missed, F.col(name))), F.lit(0)).cast("long").alias(f"_l_{name}") for name in labels],
    )

    def item(error, kind, name, n):
        return F.struct(
            F.lit(error).alias("error_type"), F.lit(kind).alias("kind"), F.lit(name).alias("item"), F.col(n).alias("n")
        )

    fixed_rows = sums.select(
        F.inline(
            F.array(
                item("false_negative", "count", "", "_fn"), item("false_positive", "count", "", "_fp"),
                *[item("false_negative", "label", name, f"_l_{name}") for name in labels],
            )
        )
    )
    categories = (
        df.filter(alarm)
        .groupBy(F.col(category).alias("item"))
        .agg(F.count("*").alias("n"))
        .select(F.lit("false_positive").alias("error_type"), F.lit("category").alias("kind"), "item", "n")
    )
    return fixed_rows.unionByName(categories)


def error_resolution(
    errors: DataFrame, prob: str = "tier2_toxic_prob", y_true: str = "any_toxic", kind: str = "tier1_error_type",
    cutoff: float = fixed.SEMANTIC_TOXIC,
) -> DataFrame:
    """What the second tier makes of the first tier's errors; here the cut-off itself is flagged."""
    judged = errors.withColumn("_pred", (F.col(prob) >= cutoff).cast("int"))
    counts = confusion_matrix(judged, y_true, "_pred", [kind])
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    right = F.col("tn") + F.col("tp")
    return counts.select(
        kind, total.alias("total"), right.alias("resolved"), (total - right).alias("unresolved"),
        F.round(100 * S.ratio(right, total), 2).alias("resolution_rate_pct"), *_metrics(6),
    )


def prob_stats(errors: DataFrame, prob: str = "tier2_toxic_prob", kind: str = "tier1_error_type") -> DataFrame:
    """Mean, median, spread and range, overall and per kind of error.

    Moments and range come from the values as they are. For the exact median, a histogram over the values' first six
    digits (at most a million cells per kind) tells in which cells the middle lies, and only the values of those cells,
    counted per value, are put in order. Scores that are null or not a number are left out of everything but ``n``.
    """
    scopes = F.explode(F.array(F.lit("overall"), F.col(kind))).alias("scope")
    rows = errors.select(scopes, S.no_nan(F.col(prob)).alias("_v"))
    moments = rows.groupBy("scope").agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    values = rows.filter("_v is not null").groupBy("scope", F.round("_v", 6).alias("_c"), "_v").agg(F.count("*").alias("_n"))
    cells = values.groupBy("scope", "_c").agg(F.sum("_n").alias("_m"))
    up_to = W.partitionBy("scope").orderBy("_c")
    placed = cells.select(
        "scope", "_c", F.sum("_m").over(up_to).alias("_to"), (F.sum("_m").over(up_to) - F.col("_m")).alias("_from"),
        F.sum("_m").over(W.partitionBy("scope")).alias("_all"),
    )
    # of `_all` values in order, those numbered `_one` and `_two` from 0 are the middle
    one, two = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = placed.withColumn("_one", one).withColumn("_two", two).filter(
        ((F.col("_from") <= F.col("_one")) & (F.col("_one") < F.col("_to"))) | ((F.col("_from") <= F.col("_two")) & (F.col("_two") < F.col("_to")))
    )
    inside = W.partitionBy("scope", "_c").orderBy("_v")
    ordered = values.join(middle, ["scope", "_c"]).select(
        "scope", "_v", "_one", "_two", (F.col("_from") + F.sum("_n").over(inside)).alias("_end"), (F.col("_from") + F.sum("_n").over(inside) - F.col("_n")).alias("_start")
    )

    def at(place: str) -> Column:
        return F.max(F.when((F.col("_start") <= F.col(place)) & (F.col(place) < F.col("_end")), F.col("_v")))

    medians = ordered.groupBy("scope").agg(((at("_one") + at("_two")) / 2).alias("median"))
    return moments.join(medians, "scope", "left").select("scope", "n", *[F.round(m, 4).alias(m) for m in ("mean", "median", "std", "min", "max")])


def decision_distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def residual_errors(
    errors: DataFrame, prob: str = "tier2_toxic_prob", kind: str = "tier1_error_type", cutoff: float = fixed.SEMANTIC_TOXIC
) -> DataFrame:
    """The errors of the first tier that the second repeats."""
    flagged = F.col(prob) >= cutoff
    return errors.filter(
        ((F.col(kind) == "false_negative") & ~flagged) | ((F.col(kind) == "false_positive") & flagged)
    )


def hard_examples(df: DataFrame, band: tuple[float, float] = fixed.HARD_EXAMPLE_BAND) -> DataFrame:
    """Wrong predictions whose probability lies inside the band, both ends included."""
    return df.filter((F.col("y_true") != F.col("y_pred")) & F.col("y_prob").between(*band))


def hard_example_report(df: DataFrame, source: str, band: tuple[float, float] = fixed.HARD_EXAMPLE_BAND) -> DataFrame:
    hard = (F.col("y_true") != F.col("y_pred")) & F.col("y_prob").between(*band)
    return df.agg(F.count("*").alias("rows_scored"), F.count_if(hard).alias("hard_examples_found")).select(
        F.lit(source).alias("source"), "rows_scored", "hard_examples_found",
        F.lit(band[0]).alias("prob_min"), F.lit(band[1]).alias("prob_max"),
    )


def ranking_quality(df: DataFrame, prob: str = "y_prob", y: str = "y_true", keys: Sequence[str] = (), bins: int = 10_000) -> DataFrame:
    """``auc`` by ``keys``: the chance that a positive row has a higher score than a negative one, equal scores counting half.

    Scores are counted in ``bins`` steps of 1 / bins, which combine before the shuffle; scores of one step count as equal.
    Null without rows of both classes. Rows without score or class are left out.
    """
    rows = df.filter(F.col(prob).isNotNull() & ~F.isnan(prob) & F.col(y).isNotNull())
    step = F.floor(F.col(prob) * bins).alias("_step")
    counts = rows.groupBy(*keys, step).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) != 1).alias("_n"))
    below = W.partitionBy(*keys).orderBy("_step").rowsBetween(W.unboundedPreceding, -1)  # at most bins + 1 rows
    wins = F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") / 2)
    return counts.withColumn("_wins", wins).groupBy(*keys).agg(F.try_divide(F.sum("_wins"), F.sum("_p") * F.sum("_n")).alias("auc"))
