"""Message triage on Spark: clean, match rules, build features, score, route, evaluate."""
