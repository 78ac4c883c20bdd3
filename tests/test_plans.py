"""Physical plans: no cross joins, pruned scans, filters at the scan, no Python where none is needed."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")

# these run jobs while they are built (fits, files, streams) and are looked at elsewhere
EAGER = {
    "svd_project", "fit_logreg", "model_store", "oof_predictions", "stacked_score_feature", "resumable_embedding",
    "stream_triage", "training_run", "preprocessing_report", "validation_report", "hybrid_report",
}


def plan(spark, name):
    return contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in set(contract.queries()) - EAGER if not re.match(r"op\d+_|pipeline$", n)))
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark):
    text = plan(spark, "read_columns_pruned")
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in text
    text = plan(spark, "attach_test_labels")
    assert "IsNotNull(doc_id)" in text and "n_chars" not in text and "lang" not in text


@pytest.mark.parametrize("name", ["triage_cascade", "tier1_inspect", "threshold_sweep", "tfidf_word", "stream_triage_batch"])
def test_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "EvalPython" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", ["clean_text", "tier1_inspect", "triage_cascade", "step_counters"])
def test_narrow_work_needs_no_key_shuffle(spark, name):
    assert "hashpartitioning" not in plan(spark, name)
