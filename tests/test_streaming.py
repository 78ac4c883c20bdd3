from pyspark.sql import functions as F

from sieveline.operators import features as X
from sieveline.streaming import jobs

SCHEMA = "id bigint, comment_text string"


def project(df):
    return X.embed_batch(df).select("id", "embedding")


def test_resumes_behind_the_last_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        return jobs.stream_project(spark, source, SCHEMA, project, out, state, max_files=1)

    def write(low, high):
        spark.range(low, high).select("id", F.concat(F.lit("text "), F.col("id")).alias("comment_text")).coalesce(2).write.mode(
            "append"
        ).parquet(source)

    write(0, 20)
    assert run().count() == 20
    assert run().count() == 20
    write(20, 30)
    done = run()
    assert done.count() == 30 and done.select("id").distinct().count() == 30


def test_a_run_that_breaks_between_two_batches(spark, tmp_path):
    """Batches committed before the break are kept, the broken one is done again, and the result equals one batch job."""
    import pytest
    from pyspark.errors import StreamingQueryException

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(60).select("id", F.concat(F.lit("text "), F.col("id")).alias("comment_text"))
    for k in range(4):  # the row that breaks the run is in the youngest file
        rows.filter(F.floor(F.col("id") / 15) == k).coalesce(1).write.mode("append").parquet(source)

    def breaks(df):
        failing = F.when(F.col("id") == 59, F.raise_error(F.lit("broken on purpose")).cast("string")).otherwise(F.col("comment_text"))
        return project(df.withColumn("comment_text", failing))

    def run(step):
        return jobs.stream_project(spark, source, SCHEMA, step, out, state, max_files=1)

    assert jobs.committed_rows(spark, out, "id bigint, embedding array<float>") == 0
    with pytest.raises(StreamingQueryException):
        run(breaks)
    assert 0 < jobs.committed_rows(spark, out, "id bigint, embedding array<float>") < 60
    done = sorted(map(str, run(project).collect()))
    assert done == sorted(map(str, project(rows).collect())) and run(project).count() == 60
