"""Inputs of the registered queries: pure functions of the given tables, over all their rows.

The test tables lack some of what the operators look for (contractions, wiki marks, disguised
words, ...), so a phrase is appended to every document by its id. Each fixture has a twin in
``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import patterns, scores, text
from sieveline.functions import rules as R
from sieveline.plans.registry import table
from sieveline.session import spread
from sieveline.sources.rules import demo_rules

PHRASES = [
    "I don't think you've read it",
    "you'd've cannot won't",
    "it's John's (talk) 12:34, January 5, 2010",
    "see http://a.example/x www.b.example",
    "my ssn is 123-45-6789",
    "ssn 666-12-3456",
    "f@ck sh!t",
    "b-a-s-t-a-r-d sh.i.t bi*tches",
    "wait!!! what??? D@MN",
    "[[User:Abc]] hello fucking",
    "card 4111 1111 1111 1111",
    "",
]
INSULTS = fixed.DEMO_RULES[0]["words"]
DEMEANING = fixed.DEMO_RULES[1]["words"]
LABELS = ["toxic", "low_quality"]

# --- fixed values: the linear model of the cascade queries, over caps, insults, demeaning words,
# repeated punctuation (at most 3) and a small term from the id that spreads the scores ---------
SCORE_INTERCEPT = -2.2
SCORE_WEIGHTS = [1.9, 3.0, 2.4, 0.7, 0.02]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    return spread(texts)


def spiked(spark: SparkSession, sf: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("id") % len(PHRASES) + 1).cast("int"))
    return documents(spark, sf).withColumn("comment_text", F.concat("comment_text", F.lit(" "), phrase))


def null_messages(spark: SparkSession, sf: str) -> DataFrame:
    c = F.when(F.col("id") % 37 == 0, F.lit(None)).when(F.col("id") % 41 == 0, F.lit("")).otherwise(F.col("comment_text"))
    return documents(spark, sf).withColumn("comment_text", c)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), "toxic", (1 - F.col("quality")).alias("low_quality")
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(labels(spark, sf), "id")


def count_words(c: Column, words) -> Column:
    return F.regexp_count(F.lower(c), F.lit(patterns.whole_words(words)))


def score_features(c: Column, key: Column) -> list[Column]:
    repeats = F.regexp_count(c, F.lit(patterns.REPEATED_PUNCTUATION))
    return [
        text.mostly_caps(c).cast("int"),
        count_words(c, INSULTS),
        count_words(c, DEMEANING),
        F.least(repeats, F.lit(3)),
        (key * 53) % 97,
    ]


def score(c: Column, key: Column) -> Column:
    return F.round(scores.linear_probability(score_features(c, key), SCORE_WEIGHTS, SCORE_INTERCEPT), 6)


def doc_score() -> Column:
    return score(F.col("comment_text"), F.col("id"))


def second_score() -> Column:
    return ((F.col("id") * 37) % 101) / F.lit(100.0)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    scored = labelled(spark, sf).withColumn("y_prob", doc_score())
    return scored.select(
        "id", "comment_text", F.col("toxic").alias("y_true"), (F.col("y_prob") > 0.5).cast("int").alias("y_pred"), "y_prob",
        *LABELS,
    )


def tier1_labelled(spark: SparkSession, sf: str) -> DataFrame:
    verdict = R.tier1_predict(text.normalize_message(F.col("comment_text")), demo_rules())
    return (
        labelled(spark, sf)
        .withColumn("any_toxic", scores.binary_target(LABELS))
        .withColumn("_v", verdict)
        .select(
            "id", "comment_text", *LABELS, "any_toxic", F.col("_v.pred").alias("tier1_pred"),
            F.col("_v.category").alias("tier1_category"),
        )
    )


def audit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    cases = [
        ["threatening_phrase"], ["insult_phrase"], ["insult_phrase", "profanity"], ["profanity"],
        ["violent_phrase", "profanity"],
    ]
    lists = F.array(*[F.array(*[F.lit(r) for r in case]) for case in cases])
    return labels(spark, sf).select(
        "id", F.element_at(lists, (F.col("id") % len(cases) + 1).cast("int")).alias("rules")
    )


REPLIES = [
    '{"reason_summary": "rude words", "risk_type": "insult", "recommended_action": "review"}',
    '{"reason_summary": "rude words", "risk_type": "rudeness", "recommended_action": "review"}',
    '{"reason_summary": "rude words", "risk_type": "insult"}',
    '{"reason_summary": "rude words", "risk_type": "insult", "recommended_action": "review", "note": "x"}',
    "no json at all",
]


def reply() -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (F.col("id") % len(REPLIES) + 1).cast("int"))


def sim_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with expected routes and decisions, one of them blank."""
    turn = (F.col("turn") % 3 + 1).cast("int")

    def pick(*options):
        return F.element_at(F.array(*[F.lit(o) for o in options]), turn)

    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("comment_text"),
        pick(" tier2", "TIER1", "").alias("expected_route"), pick("ok", "FLAGGED", "ok ").alias("expected_decision"),
    )


def logits() -> Column:
    return text.bind(doc_score(), lambda p: F.array(F.round(2 - 4 * p, 6), F.round(4 * p - 2, 6)))
