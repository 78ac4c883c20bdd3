import json

import pytest
from pyspark.sql import types as T

from sieveline.operators import joins as J
from sieveline.operators import profile as P
from sieveline.sources import tables as src

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("comment_text", T.StringType()), T.StructField("toxic", T.IntegerType())])


def test_csv_round_trip_and_nulls(spark, tmp_path):
    rows = [
        (1, 'a "quoted"\nline, with comma', 0), (2, None, 1), (3, "", None), (4, "NA", 1), (5, "  kept blanks ", 0),
        (6, "back\\slash", 0), (7, "null", 1), (8, " NA", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    src.write_table(df, str(tmp_path / "out"))
    got = {r["id"]: (r["comment_text"], r["toxic"]) for r in src.read_messages_csv(spark, str(tmp_path / "out"), SCHEMA).collect()}
    assert got == {
        1: (rows[0][1], 0), 2: (None, 1), 3: (None, None), 4: (None, 1), 5: ("  kept blanks ", 0), 6: ("back\\slash", 0),
        7: (None, 1), 8: (" NA", 0),
    }
    assert [r["id"] for r in src.read_messages_csv(spark, str(tmp_path / "out"), "id bigint, comment_text string, toxic int", nrows=2).collect()] == [1, 2]
    src.write_table(df, str(tmp_path / "out.parquet"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 8


def test_required_columns(spark):
    df = spark.range(1)
    assert src.missing_columns(df, ["id", "x", "y"]) == ["x", "y"]
    with pytest.raises(src.MissingColumns, match="x, y"):
        src.require_columns(df, ["id", "x", "y"])


def test_report_is_nested_json(spark, tmp_path):
    report = spark.range(1).coalesce(1).selectExpr("named_struct('rows', id, 'none', cast(null as int)) AS dataset", "map('a', 1) AS counts")
    src.write_report(report, str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*.json")
    assert json.loads(part.read_text()) == {"dataset": {"rows": 0, "none": None}, "counts": {"a": 1}}


def test_integrity(spark):
    labels = ["toxic"]
    a = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 1)], "id int, toxic int")
    same = J.integrity_check(a.filter("toxic IS NOT NULL"), a.filter("toxic IS NOT NULL"), labels).first()
    assert same.passed and same.mismatch_toxic == 0
    null = J.integrity_check(a, a, labels).first()
    assert not null.passed and null.mismatch_toxic == 1
    fewer = J.integrity_check(a, a.filter("id < 4"), labels).first()
    assert not fewer.row_count_match and not fewer.passed and fewer.mismatch_toxic == 0
    gone = J.integrity_check(a, a.drop("toxic"), labels).first()
    assert gone.missing_columns == "toxic" and not gone.passed and gone.original_rows == gone.preprocessed_rows == 4
    copies = spark.createDataFrame([(1, 0)] * 3 + [(2, 1)], "id int, toxic int")
    moved = J.integrity_check(a, copies, labels).first()
    assert moved.duplicate_rows == 2 and moved.mismatch_id == 3 and not moved.passed


def test_embeddings_must_match(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    one = spark.createDataFrame([(1, [0.5])], "id int, embedding array<float>")
    with pytest.raises(ValueError):
        J.attach_embeddings(df, one)
    assert J.attach_embeddings(df, one, strict=False).count() == 1
    assert J.attach_embeddings(df.filter("id = 1"), one).count() == 1


def test_audit_over_several_candidate_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (5, None)], "id int, toxic int")
    candidates = spark.createDataFrame(
        [(1, ["insult_phrase"]), (1, ["profanity"]), (2, ["profanity"]), (3, ["violent_phrase"]), (9, ["violent_phrase"])],
        "id int, rules array<string>",
    )
    out = {r["id"]: (r["toxic"], r["corrected"]) for r in J.apply_label_audit(df, candidates).collect()}
    assert out == {1: (1, True), 2: (0, False), 3: (1, False), 4: (0, False), 5: (None, False)}
    report = J.label_audit_report(df, candidates).first()
    assert (report.audit_rows_loaded, report.high_confidence_candidates, report.rows_corrected) == (5, 3, 1)
    assert report.corrected_ids_sample == "1"


def test_statistics_of_small_tables(spark):
    df = spark.createDataFrame([("a" * n,) for n in (0, 3, 3, 10)] + [(None,)], "comment_text string")
    stats = P.length_stats(df).first().asDict()
    assert stats == {"mean": 4.0, "median": 3.0, "std": 4.24, "min": 0, "max": 10, "p25": 2.25, "p75": 4.75, "p95": 8.95}
    assert P.length_stats(df.limit(0)).first()["mean"] is None
    none = P.drop_null_report(spark.createDataFrame([(1, "x")], "id int, comment_text string")).first()
    assert (none.rows_before, none.rows_dropped, none.rows_after) == (1, 0, 1)


def test_invalid_rows_and_copies(spark):
    rows = [(1, "a", 0), (1, "b", 1), (1, "c", 1), (2, " ", 0), (3, "x", None), (4, "x", -1), (5, "x", 7), (6, "x", 1)]
    df = spark.createDataFrame(rows, "id int, comment_text string, toxic int")
    assert P.drop_invalid_report(df, ["toxic"]).first().asDict() == {
        "input_rows": 8, "duplicate_ids": 2, "empty_comment_text": 1, "missing_label_values": 1, "invalid_label_values": 1,
        "rows_with_minus_one_labels": 1, "output_rows": 2, "non_toxic": 1, "toxic": 1,
    }
    assert sorted(r["id"] for r in P.drop_invalid_labels(df, ["toxic"]).collect()) == [1, 6]
