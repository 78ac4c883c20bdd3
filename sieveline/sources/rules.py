"""The rule table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions.rules import Rule, make_rules

RULE_SCHEMA = (
    "ord int, category string, type string, boundary boolean, words array<string>, pattern string"
)


def default_rules() -> list[Rule]:
    return make_rules(fixed.DEFAULT_RULES)


def demo_rules() -> list[Rule]:
    """The default rules and two lexicons of words that occur in the test tables."""
    return make_rules(fixed.DEFAULT_RULES + fixed.DEMO_RULES)


def load_rules(path: str, spark: SparkSession | None = None) -> list[Rule]:
    """Rules from a ``rules:`` list in a YAML or JSON file.

    With a session the file is read by Spark, so it may lie in any store that Spark reads; else by the driver.
    """
    if spark is not None:
        content = spark.read.text(path, wholetext=True).first()["value"]  # a rule file is small
    else:
        with open(path, encoding="utf-8") as file:
            content = file.read()
    if path.endswith(".json"):
        return make_rules(json.loads(content)["rules"])
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML rules needs the yaml package; use JSON instead") from error
    return make_rules(yaml.safe_load(content)["rules"])


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule, words longest first."""
    rows = [
        (r.ord, r.category, r.type, r.boundary, sorted(r.words, key=len, reverse=True), r.pattern)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_words(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per lexicon word. A word listed twice counts for its first rule."""
    return (
        rules_table(spark, rules)
        .select("ord", "category", F.explode("words").alias("term"))
        .groupBy("term")
        .agg(F.min("ord").alias("ord"), F.min_by("category", "ord").alias("category"))
    )
