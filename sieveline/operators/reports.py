"""Jobs that write a table and tell what they did: cleaning with its counters, validation that can abort, hybrid scoring.

Counters are observed while the rows pass on their way to the file, so a job reads its input once. Reports are nested tables of
one row; `sieveline.sources.tables.write_report` writes them as JSON.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import text
from sieveline.operators import profile
from sieveline.operators.joins import integrity_check
from sieveline.operators.routing import hybrid_breakdown
from sieveline.sources.tables import write_report, write_table

TOP = 20


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.lower().endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def _number(n, kind: str = "bigint"):
    return F.lit(n).cast(kind)


def _counts(found: list[tuple[str, int]]):
    """Names and numbers as an array of pairs, which keeps their order."""
    items = [F.struct(F.lit(k).alias("name"), _number(n).alias("n")) for k, n in found]
    return F.array(*items) if items else F.array().cast("array<struct<name:string,n:bigint>>")


def clean_with_report(
    df: DataFrame, path: str, text_col: str = "comment_text", config: text.CleanConfig = text.CleanConfig(), source: str = "", report_path: str | None = None
) -> DataFrame:
    """Write the cleaned table to ``path`` and return the report of the run; with ``report_path`` it is written as JSON, too.

    Rows are cleaned, counted and written in one pass. Every step, every contraction and every profanity stem is a sum that goes along;
    text lengths are read from the written table.
    """
    started = time.monotonic()
    staged = profile.tracked_stages(df, text_col, config)
    seen = Observation()
    stems, forms = list(fixed.PROFANITY_STEMS), list(fixed.CONTRACTIONS)
    occurrences = lambda column, word: F.coalesce(F.sum(F.size(F.filter(column, lambda x: x == word))), F.lit(0))
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(text_col).isNull()).alias("nulls")]
    for n, step in enumerate(profile.STEPS):
        metrics += [F.count_if(F.col(f"_n_{step}") > 0).alias(f"r{n}"), F.coalesce(F.sum(f"_n_{step}"), F.lit(0)).alias(f"m{n}")]
    metrics += [occurrences("_profanity", w).alias(f"p{n}") for n, w in enumerate(stems)] + [occurrences("_contractions", w).alias(f"c{n}") for n, w in enumerate(forms)]
    cleaned = staged.observe(seen, *metrics).withColumn(text_col, F.col("_clean")).select(*df.columns)
    write_table(cleaned, path)
    found = seen.get
    spark = df.sparkSession
    lengths = profile.length_stats(_read_back(spark, path).select(F.coalesce(text_col, F.lit("")).alias(text_col)), text_col)
    listed = lambda prefix, names: sorted(((w, found[f"{prefix}{n}"]) for n, w in enumerate(names) if found[f"{prefix}{n}"]), key=lambda x: (-x[1], x[0]))[:TOP]
    steps = [F.struct(F.lit(s).alias("step"), _number(found[f"r{n}"]).alias("rows_affected"), _number(found[f"m{n}"]).alias("total_matches")) for n, s in enumerate(profile.STEPS)]
    switches = ("normalize_unicode", "unescape_html", "strip_wiki", "strip_urls", "expand_contractions", "deobfuscate", "collapse_punct", "strip_non_alnum", "detect_caps")
    report = lengths.select(
        F.struct(F.lit(datetime.now(timezone.utc).isoformat()).alias("timestamp"), F.lit(round(time.monotonic() - started, 3)).alias("elapsed_seconds")).alias("meta"),
        F.struct(F.lit(source).alias("input"), F.lit(path).alias("output"), F.lit(report_path or "").alias("report")).alias("files"),
        F.struct(
            _number(found["rows"]).alias("total_rows"), _number(found["nulls"]).alias("nan_filled"), _number(found[f"r{profile.STEPS.index('empty_or_nan')}"]).alias("empty_or_nan_texts"),
        ).alias("dataset"),
        F.struct(*[F.lit(getattr(config, s)).alias(s) for s in switches], F.lit(len(config.custom_steps)).alias("custom_steps_count")).alias("pipeline_config"),
        F.struct(F.array(*steps).alias("steps"), _counts(listed("c", forms)).alias("contractions_top_20"), _counts(listed("p", stems)).alias("profanity_by_word")).alias("transformations"),
        F.struct(*lengths.columns).alias("text_length_stats_post"),
    )
    if report_path:
        write_report(report, report_path)
    return report


def validate(
    original: DataFrame, prepared: DataFrame, labels: Sequence[str], path: str, compared: Sequence[str] | None = None, text_col: str = "comment_text", id_col: str = "id",
    report_path: str | None = None,
) -> DataFrame:
    """Check a prepared table against its original, drop its null texts, write the rest to ``path``, and return the nested report.

    If the tables differ in columns, rows or values of ``compared`` (all labels if not given), the job ends there: status ``aborted``, the
    later parts of the report are null and nothing is written.
    """
    integrity = integrity_check(original, prepared, labels if compared is None else compared, id_col).first()  # one row
    spark = prepared.sparkSession
    parts = [F.struct(*[F.lit(v).cast(t).alias(c) for (c, t), v in zip(_types(integrity), integrity)]).alias("integrity")]
    passed = integrity["passed"]
    kept = f"struct<column_nulls: array<struct<column: string, nulls: bigint, percentage: double>>, total_nulls: bigint, rows_with_any_null: bigint>"
    if not passed:
        report = spark.range(1).select(
            F.lit("aborted").alias("status"), *parts, F.lit(None).cast(kept).alias("null_profile"),
            F.lit(None).cast("struct<rows_before: bigint, rows_dropped: bigint, rows_after: bigint, dropped_ids_sample: string>").alias("null_rows"),
            F.lit(None).cast("array<struct<label: string, positive: bigint, negative: bigint, positive_rate: double, empty_texts: bigint>>").alias("labels"),
            F.lit(None).cast("struct<mean: double, median: double, std: double, min: bigint, max: bigint, p25: double, p75: double, p95: double>").alias("text_length_stats"),
        )
    else:
        nulls = profile.null_profile(prepared).collect()  # one row per column
        dropped = profile.drop_null_report(prepared, text_col, id_col).first()
        write_table(profile.drop_null_text(prepared, text_col), path)
        valid = _read_back(spark, path)
        shares = profile.label_distribution(valid, labels, text_col).collect()  # one row per label
        columns = [F.struct(F.lit(r["column"]).alias("column"), _number(r["nulls"]).alias("nulls"), F.lit(r["percentage"]).cast("double").alias("percentage")) for r in nulls]
        report = profile.length_stats(valid, text_col).select(
            F.lit("validated").alias("status"), *parts,
            F.struct(
                (F.array(*columns) if columns else F.array()).alias("column_nulls"), _number(nulls[0]["total_nulls"] if nulls else 0).alias("total_nulls"),
                _number(nulls[0]["rows_with_any_null"] if nulls else 0).alias("rows_with_any_null"),
            ).cast(kept).alias("null_profile"),
            F.struct(
                *[_number(dropped[c]).alias(c) for c in ("rows_before", "rows_dropped", "rows_after")], F.lit(dropped["dropped_ids_sample"]).cast("string").alias("dropped_ids_sample"),
            ).alias("null_rows"),
            F.array(*[F.struct(
                F.lit(r["label"]).alias("label"), _number(r["positive"]).alias("positive"), _number(r["negative"]).alias("negative"),
                F.lit(r["positive_rate"]).cast("double").alias("positive_rate"), _number(r["empty_texts"]).alias("empty_texts"),
            ) for r in shares]).alias("labels"),
            F.struct("mean", "median", "std", "min", "max", "p25", "p75", "p95").alias("text_length_stats"),
        )
    if report_path:
        write_report(report, report_path)
    return report


def _types(row) -> list[tuple[str, str]]:
    kinds = {bool: "boolean", int: "bigint", str: "string", float: "double"}
    return [(c, kinds.get(type(v), "string")) for c, v in row.asDict().items()]


def hybrid_report(hybrid: DataFrame, dataset: str = "", safe: float = fixed.HYBRID_SAFE, toxic: float = fixed.HYBRID_TOXIC, second_toxic: float = fixed.HYBRID_SECOND) -> DataFrame:
    """The report of a hybrid run: rows, how many each source decided, the cut-offs."""
    sources = hybrid_breakdown(hybrid).agg(F.sum("n").alias("rows"), F.collect_list(F.struct("decision_source", "n", "percent")).alias("breakdown"))  # three rows
    return sources.select(
        F.lit(datetime.now(timezone.utc).isoformat()).alias("timestamp"), F.lit(dataset).alias("dataset"), F.col("rows").alias("total_samples"), "breakdown",
        F.struct(F.lit(safe).alias("safe_below"), F.lit(toxic).alias("toxic_above"), F.lit(second_toxic).alias("second_toxic_above")).alias("thresholds"),
    )
