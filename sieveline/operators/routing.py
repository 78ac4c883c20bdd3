"""Cascades: rules first, then a score, then bands; hybrid fallback; simulation comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import fixed
from sieveline.functions import rules as R
from sieveline.functions import scores as S
from sieveline.functions import text

Scorer = Callable[[DataFrame], DataFrame]


def hybrid_fallback(
    df: DataFrame,
    second: Scorer | Callable[[Column], Column],
    prob: str = "lr_prob",
    safe: float = fixed.HYBRID_SAFE,
    toxic: float = fixed.HYBRID_TOXIC,
    second_toxic: float = fixed.HYBRID_SECOND,
    as_column: bool = True,
) -> DataFrame:
    """Clear rows decided by the first model, the rest by ``second``.

    As a column, ``second`` is a function of the condition under which it is needed, and everything
    is one pass: a JVM expression is skipped elsewhere, and a batch function should take
    ``when(needed, text)``, so that other rows reach it as nulls. A model that is a job of its own
    (``as_column=False``) gets the middle band alone as a table and adds ``bert_prob``; the first
    probability should then be a stored column, since both bands read it.
    """
    p = S.no_nan(F.col(prob))
    # a first score that is null or not a number decides nothing
    is_safe, is_toxic = F.coalesce(p < safe, F.lit(False)), F.coalesce(p > toxic, F.lit(False))
    middle = ~(is_safe | is_toxic)

    def decided(rows: DataFrame) -> DataFrame:
        fallback = F.col("bert_prob") > second_toxic
        return rows.select(
            "*",
            F.when(is_safe, F.lit(0)).when(is_toxic, F.lit(1)).otherwise(fallback.cast("int")).alias("y_pred"),
            F.when(middle, F.col("bert_prob")).otherwise(p).alias("y_prob"),
            F.when(is_safe, F.lit("lr_safe")).when(is_toxic, F.lit("lr_toxic")).otherwise(F.lit("bert_fallback")).alias("decision_source"),
        )

    if as_column:
        return decided(df.withColumn("bert_prob", F.when(middle, second(middle)).cast("double")))
    scored = second(df.filter(middle)).withColumn("bert_prob", F.col("bert_prob").cast("double"))
    clear = df.filter(~middle).withColumn("bert_prob", F.lit(None).cast("double"))
    return decided(clear.unionByName(scored))


def hybrid_breakdown(hybrid: DataFrame) -> DataFrame:
    """Rows and percent per decision source; all three sources are always listed."""
    names = ["lr_safe", "lr_toxic", "bert_fallback"]
    counts = hybrid.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col("decision_source") == n).alias(n) for n in names]
    )
    items = F.array(*[F.struct(F.lit(n).alias("decision_source"), F.col(n).alias("n")) for n in names])
    return counts.select("rows", F.inline(items)).select(
        "decision_source", "n", F.round(F.try_divide(100.0 * F.col("n"), F.col("rows")), 2).alias("percent")
    )


def reason_is_valid(reply: Column) -> Column:
    """One JSON object and nothing after it: exactly the three keys, all texts, and both enumerations respected."""
    keys, parsed = F.json_object_keys(reply), F.try_parse_json(reply)
    fields = {k: F.try_variant_get(parsed, f"$.{k}", "string") for k in fixed.REASON_KEYS}
    texts = [F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "STRING" for k in fixed.REASON_KEYS]
    alone = F.json_array_length(F.concat(F.lit("["), reply, F.lit("]"))) == 1
    wanted = F.array(*[F.lit(k) for k in fixed.REASON_KEYS])
    return F.coalesce(
        (F.size(keys) == len(fixed.REASON_KEYS))
        & (F.size(F.array_except(wanted, keys)) == 0)
        & alone & texts[0] & texts[1] & texts[2]
        & fields["risk_type"].isin(*fixed.RISK_TYPES)
        & fields["recommended_action"].isin(*fixed.REASON_ACTIONS),
        F.lit(False),
    )


def parse_reason_json(reply: Column, decision: Column) -> Column:
    """The explanation of a flagged message; a bad reply gives the fixed fallback, and messages that
    are not flagged have none."""
    parsed = F.from_json(reply, "reason_summary string, risk_type string, recommended_action string")
    fallback = F.struct(*[F.lit(fixed.REASON_FALLBACK[k]).alias(k) for k in fixed.REASON_KEYS])
    return F.when(decision == "FLAGGED", F.when(reason_is_valid(reply), parsed).otherwise(fallback))


TIER2_TYPE = T.StructType(
    [
        T.StructField("decision", T.StringType()),
        T.StructField("toxic_prob", T.DoubleType()),
        T.StructField("confidence_pct", T.DoubleType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason_summary", T.StringType()),
        T.StructField("risk_type", T.StringType()),
        T.StructField("recommended_action", T.StringType()),
    ]
)


def _tier2(decision, prob, confidence, action, reason=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        decision.alias("decision"), prob.alias("toxic_prob"), confidence.alias("confidence_pct"), action.alias("action"),
        *[(none if reason is None else reason[k]).alias(k) for k in fixed.REASON_KEYS],
    ).cast(TIER2_TYPE)


def triage_columns(
    df: DataFrame, rules: list[R.Rule], prob: Column, bands: S.Bands = S.RUNTIME_BANDS, text_col: str = "comment_text",
    reply: Column | None = None,
) -> DataFrame:
    """The cascade as one narrow projection, for scores that are plain expressions.

    Adds ``final_decision, decided_by, tier1, tier2``. Works on streams as well as on tables. ``prob``
    is only evaluated for messages that pass the rules.
    """
    staged = df.withColumn("_norm", text.normalize_message(F.col(text_col)))
    staged = staged.withColumn("_t1", R.tier1_inspect(F.col("_norm"), rules))
    empty, hit = F.col("_norm") == "", F.col("_t1.status") == "FLAGGED"
    staged = staged.withColumn("_p", F.when(~(empty | hit), prob))
    staged = staged.withColumn("_route", S.route_bands(F.col("_p"), bands))
    return _assemble(staged, empty, hit, reply)


def _assemble(staged: DataFrame, empty: Column, hit: Column, reply: Column | None) -> DataFrame:
    none = F.lit(None).cast("string")
    route = F.col("_route")
    reason = None if reply is None else parse_reason_json(reply, route["decision"])
    passed = F.struct(F.lit("PASS").alias("status"), none.alias("reason"), none.alias("trigger"))
    nothing = _tier2(F.lit("OK"), F.lit(0.0), F.lit(0.0), F.lit(fixed.EMPTY_INPUT_ACTION))
    scored = _tier2(route["decision"], route["toxic_prob"], route["confidence"], route["action"], reason)
    return (
        staged.withColumn(
            "final_decision",
            F.when(empty, F.lit("OK")).when(hit, F.lit("FLAGGED")).otherwise(route["decision"]),
        )
        .withColumn(
            "decided_by",
            F.when(empty, F.lit(fixed.DECIDED_BY_INPUT))
            .when(hit, F.lit(fixed.DECIDED_BY_RULES))
            .otherwise(F.lit(fixed.DECIDED_BY_MODEL)),
        )
        .withColumn("tier1", F.when(empty, passed).otherwise(F.col("_t1")))
        .withColumn("tier2", F.when(empty, nothing).when(~hit, scored))
        .drop("_norm", "_t1", "_p", "_route")
    )


def triage_cascade(
    df: DataFrame, rules: list[R.Rule], scorer: Scorer, bands: S.Bands = S.RUNTIME_BANDS, text_col: str = "comment_text",
    reply: Column | None = None,
) -> DataFrame:
    """The cascade for any scorer, one that uses a model or batch functions included.

    ``scorer`` gets only the messages that pass the rules, with their normalised text in ``_norm``,
    and adds ``_p``; the others are stacked back around it.
    """
    staged = df.withColumn("_norm", text.normalize_message(F.col(text_col)))
    staged = staged.withColumn("_t1", R.tier1_inspect(F.col("_norm"), rules))
    empty, hit = F.col("_norm") == "", F.col("_t1.status") == "FLAGGED"
    decided = staged.filter(empty | hit).withColumn("_p", F.lit(None).cast("double"))
    rest = scorer(staged.filter(~(empty | hit)))
    both = decided.unionByName(rest).withColumn("_route", S.route_bands(F.col("_p"), bands))
    return _assemble(both, empty, hit, reply)


def flat_result(triaged: DataFrame, *keep: str) -> DataFrame:
    """The nested result as plain columns."""
    return triaged.select(
        *keep, "final_decision", "decided_by",
        F.col("tier1.status").alias("tier1_status"), F.col("tier1.reason").alias("tier1_reason"),
        F.col("tier1.trigger").alias("tier1_trigger"), F.col("tier2.decision").alias("tier2_decision"),
        F.col("tier2.toxic_prob").alias("tier2_prob"), F.col("tier2.confidence_pct").alias("tier2_confidence_pct"),
        F.col("tier2.action").alias("tier2_action"), F.col("tier2.reason_summary").alias("reason_summary"),
        F.col("tier2.risk_type").alias("risk_type"), F.col("tier2.recommended_action").alias("recommended_action"),
    )


def cascade_flagged_variant(
    df: DataFrame, rules: list[R.Rule], prob: Column, bands: S.Bands = S.SEMANTIC_BANDS, text_col: str = "comment_text"
) -> DataFrame:
    """The two-way cascade: ambiguous counts as flagged. Adds ``prediction`` and ``caught_by``."""
    staged = df.withColumn("_reason", R.tier1_inspect_ruleorder(F.col(text_col), rules))
    staged = staged.withColumn("_d", F.when(F.col("_reason").isNull(), S.band_decision(prob, bands)))
    by_rules, by_model = F.col("_reason").isNotNull(), F.col("_d") != "OK"
    return (
        staged.withColumn("prediction", F.when(by_rules | by_model, F.lit(1)).otherwise(F.lit(0)))
        .withColumn(
            "caught_by",
            F.when(by_rules, F.lit(fixed.CAUGHT_BY_RULES))
            .when(by_model, F.lit(fixed.CAUGHT_BY_MODEL))
            .otherwise(F.lit(fixed.PASSED_BY_MODEL)),
        )
        .drop("_reason", "_d")
    )


def simulation_compare(
    triaged: DataFrame, id_col: str = "id", text_col: str = "comment_text"
) -> DataFrame:
    """Expected against actual route and decision, flattened to 19 columns.

    The expected route matches if it is contained in the actual one, so a blank always matches. A missing one (null)
    never does.
    """

    def expected(name: str) -> Column:
        return F.upper(text.trim_blanks(F.col(name)))

    flat = flat_result(
        triaged.withColumn("_er", expected("expected_route")).withColumn("_ed", expected("expected_decision")),
        id_col, text_col, "_er", "_ed",
    )
    raw = F.lower("decided_by")
    route = (
        F.when(F.contains(raw, F.lit("tier 1")), F.lit("TIER1"))
        .when(F.contains(raw, F.lit("tier 2")), F.lit("TIER2"))
        .otherwise(F.lit("UNKNOWN"))
    )
    return flat.withColumn("actual_route", route).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("comment_text"),
        F.col("_er").alias("expected_route"), "actual_route", F.col("decided_by").alias("actual_route_raw"),
        F.col("_ed").alias("expected_decision"), F.col("final_decision").alias("actual_decision"),
        F.coalesce(F.contains(F.col("actual_route"), F.col("_er")), F.lit(False)).cast("int").alias("route_match"),
        F.coalesce(F.col("_ed") == F.col("final_decision"), F.lit(False)).cast("int").alias("decision_match"),
        "tier1_status", "tier1_reason", "tier1_trigger", "tier2_decision", "tier2_prob", "tier2_confidence_pct",
        "tier2_action", "reason_summary", "risk_type", "recommended_action",
    )


def simulation_accuracy(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("rows"),
        F.round(F.avg("route_match"), 4).alias("route_accuracy"),
        F.round(F.avg("decision_match"), 4).alias("decision_accuracy"),
        F.count_if(F.col("decision_match") == 0).alias("mismatches"),
    )
