"""The training-data pipeline: documents in, token digests of the documents that are kept out.

Toxic documents go, then documents of low quality, then near-duplicates (one of each group stays), then documents that
hold a benchmark item; the rest is encoded. Every stage works on all that the stage before it kept, and every stage but
the last returns the columns of its input.

Rows with a null id are judged by their own text and never linked. Repeated rows of one id and text count as one document
from the near-duplicate stage on. An empty table runs through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, neardup, piece_codec, quality_crf, toxicity
from sieveline.llm.common import forget, keep_table, read_table, small_batches
from sieveline.llm.filters import divided
from sieveline.llm.queries import tokenizer_file


def without(docs: DataFrame, removed: DataFrame, name: str) -> DataFrame:
    """Documents whose id is not among ``removed``; that is written first. Documents that a filter of its ids tells apart are not joined at all."""
    removed = keep_table(removed.filter("doc_id is not null").select("doc_id").distinct(), name)
    doubtful, others = divided(docs, "doc_id", neardup.filter_of(removed, "doc_id"))
    return doubtful.join(removed, "doc_id", "left_anti").select(docs.columns).unionByName(others.select(docs.columns))


def accepted(docs: DataFrame, score: Callable[[DataFrame], DataFrame], predicted: int) -> DataFrame:
    """Rows that a scorer marks ``predicted``. Columns named like one that scorers add go along inside a struct, so that they keep their values."""
    if not {"held_out", "score", "predicted", "evidence", "lines"} & set(docs.columns):
        return score(docs).filter(F.col("predicted") == predicted).select(docs.columns)
    wrapped = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return score(wrapped).filter(F.col("predicted") == predicted).select("_row.*")


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity votes accept."""
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels")
    return accepted(docs, lambda d: toxicity.toxicity_scores(d, labels, carry=True), 0)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts."""
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels")
    return accepted(docs, lambda d: quality_crf.quality_scores(d, labels, carry=True), 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id."""
    small_batches(spark)
    found = neardup.near_duplicates(docs, size=5, percent=80)
    left = without(docs, found.filter(~F.col("kept")), "pipeline-copies")
    twice = keep_table(left.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "pipeline-repeated")
    repeated = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(repeated.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows with a null id are searched under a digest of their text."""
    small_batches(spark)
    items = read_table(spark, sf_dir, "benchmark")
    known, nameless = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    clean = without(known, decontaminate.contaminated(known, items), "pipeline-leaks")
    keyed = nameless.withColumn("_key", F.xxhash64("text"))
    found = decontaminate.contaminated(keyed.select(F.col("_key").alias("doc_id"), "text").distinct(), items)
    leaks = keep_table(found.select(F.col("doc_id").alias("_key")).distinct(), "pipeline-nameless-leaks")
    return clean.unionByName(keyed.join(leaks, "_key", "left_anti").select(docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests, with the digest of the decoded text."""
    small_batches(spark)
    return piece_codec.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False)


STAGES = [
    ("toxicity", clean_speech),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
ORACLE_SQL = None  # votes, the field and the alignment have no SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep_table(docs, f"pipeline-{name}")
            if before is not None:
                forget(before)
            before = docs
    return docs
