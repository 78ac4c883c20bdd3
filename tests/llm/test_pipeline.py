"""The pipeline's stages, one after the other, against their operators and plain checks."""

from pathlib import Path

import pytest

import corpus_pipeline
from sieveline.llm import decontaminate, neardup, quality_crf, toxicity
from sieveline.llm.common import keep_table
from sieveline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


def test_stages(spark):
    labels, items = spark.read.parquet(f"{SF_DIR}/labels.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = {
        "toxicity": lambda d: ids(toxicity.toxicity_scores(d, labels).filter("predicted = 0")),
        "quality": lambda d: ids(quality_crf.quality_scores(d, labels).filter("predicted = 1")),
        "near_dedup": lambda d: ids(neardup.near_duplicates(d, size=5).filter("kept")),
        "decontamination": lambda d: sorted(set(ids(d)) - set(ids(decontaminate.contaminated(d, items)))),
        "encoding": ids,
    }
    for name, stage in corpus_pipeline.STAGES:
        after = keep_table(stage(spark, docs, SF_DIR), name)
        assert ids(after) == expected[name](docs)
        assert name == "encoding" or after.columns == docs.columns
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, docs.collect()))


def test_rows_of_one_id_and_nulls(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", None, None), (None, "a b c d e f g", None, "s", 2), (3, None, None, None, None), (4, "h i j k l m", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 3, 4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_clashing_columns_and_a_hot_group(spark):
    """Columns named like those of the operators keep their values; most rows are copies of one text."""
    words = [f"word{k}" for k in range(40)]
    rows = [(i, " ".join(words) if i % 3 else " ".join(words[i % 17 :]) + f" own{i}", f"s{i}", i, 7, -1, "e") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int, component_id int, kept int, `_text` string").repartition(4)
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = keep_table(stage(spark, docs, SF_DIR), name)
        assert after.columns == docs.columns
        assert all((r["score"], r["predicted"], r["component_id"], r["kept"], r["_text"]) == (f"s{r['doc_id']}", r["doc_id"], 7, -1, "e") for r in after.collect())
        docs = after
    left = [r["doc_id"] for r in docs.collect()]
    assert sum(i % 3 > 0 for i in left) <= 1 and len(left) == len(set(left))


def test_null_ids_are_decontaminated(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    rows = [(None, f"before {item} after"), (None, f"before {item} after"), (None, "clean words of no item"), (None, None), (5, f"x {item}"), (6, "clean words of no item")]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, "clean words of no item"), (6, "clean words of no item")]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
