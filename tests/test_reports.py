"""Jobs that write a table and report on it."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from sieveline.functions.text import CleanConfig
from sieveline.operators import profile, reports

S = "id int, comment_text string"
TEXTS = ["I don't KNOW, they're f@ck!! http://a.b", "don't", None, "  ", "b-a-s-t-a-r-d &amp; co", "WAIT WHAT??? (talk)", ""]


def test_cleaning_report_equals_its_parts(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), S)
    for n, config in enumerate((CleanConfig(), CleanConfig(strip_urls=False, deobfuscate=False, strip_non_alnum=False, expand_contractions=False))):
        path = str(tmp_path / f"c{n}.parquet")
        report = reports.clean_with_report(df, path, config=config, report_path=str(tmp_path / f"r{n}")).first()
        written = spark.read.parquet(path)
        assert sorted(map(tuple, written.collect())) == sorted(map(tuple, profile.clean_messages(df, config=config).collect()))
        want = {r["step"]: (r["rows_affected"], r["total_matches"]) for r in profile.step_counters(df, config=config).collect()}
        assert {s["step"]: (s["rows_affected"], s["total_matches"]) for s in report["transformations"]["steps"]} == want
        assert [(c["name"], c["n"]) for c in report["transformations"]["contractions_top_20"]] == [tuple(r) for r in profile.contraction_top(df, config=config).collect()]
        assert {c["name"]: c["n"] for c in report["transformations"]["profanity_by_word"]} == {r["word"]: r["n"] for r in profile.profanity_by_word(df, config=config).collect()}
        assert report["text_length_stats_post"]["max"] == written.select(F.max(F.length("comment_text"))).first()[0]
        assert (report["dataset"]["total_rows"], report["dataset"]["nan_filled"], report["dataset"]["empty_or_nan_texts"]) == (7, 1, 3)
        saved = json.loads(next(Path(tmp_path / f"r{n}").glob("part-*")).read_text())
        assert saved["pipeline_config"]["strip_urls"] == config.strip_urls and saved["files"]["output"] == path


def test_cleaning_nothing(spark, tmp_path):
    report = reports.clean_with_report(spark.createDataFrame([], S), str(tmp_path / "c.csv")).first()
    assert report["dataset"]["total_rows"] == 0 and report["transformations"]["contractions_top_20"] == [] and report["text_length_stats_post"]["mean"] is None


def test_validation_goes_through_or_aborts(spark, tmp_path):
    rows = [(1, "one", 1), (2, "two two", 0), (3, "three", 0), (4, "", 1)]
    df = spark.createDataFrame(rows, "id int, comment_text string, toxic int")
    prepared = df.withColumn("comment_text", F.when(F.col("id") != 3, F.col("comment_text")))
    path = str(tmp_path / "v.parquet")
    report = reports.validate(df, prepared, ["toxic"], path).first()
    assert report["status"] == "validated" and report["integrity"]["passed"] and spark.read.parquet(path).count() == 3
    assert report["null_profile"]["column_nulls"][0].asDict() == {"column": "comment_text", "nulls": 1, "percentage": 25.0}
    assert report["null_rows"]["rows_dropped"] == 1 and report["null_rows"]["dropped_ids_sample"] == "3"
    assert report["labels"][0]["positive"] == 2 and report["labels"][0]["empty_texts"] == 1
    assert report["text_length_stats"]["max"] == 7
    for n, broken in enumerate((prepared.withColumn("toxic", 1 - F.col("toxic")), prepared.limit(2), prepared.drop("toxic"))):
        gone = tmp_path / f"a{n}.parquet"
        report = reports.validate(df, broken, ["toxic"], str(gone), report_path=str(tmp_path / f"ra{n}")).first()
        assert report["status"] == "aborted" and report["labels"] is None and report["null_rows"] is None and not gone.exists()
        assert not report["integrity"]["passed"]


def test_counters_count_once_and_twice_the_same(spark):
    """Pieces between matches against counting and replacing apart."""
    from sieveline.functions import patterns, text

    rows = ["", "x", "!!x!!", "a!!b", "http://a", "x http://a y www.b", "..", "[[User:a]] (talk) b"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for pattern in (patterns.WIKI_MARKS, patterns.URLS_AND_IPS, patterns.NOT_ALPHANUMERIC):
        pieces = text.cut_at(F.col("t"), pattern)
        out = df.select((F.size(pieces) - 1).alias("n"), F.array_join(pieces, " ").alias("s"), F.regexp_count("t", F.lit(pattern)).alias("m"), F.regexp_replace("t", pattern, " ").alias("r"))
        assert all(r["n"] == r["m"] and r["s"] == r["r"] for r in out.collect())
