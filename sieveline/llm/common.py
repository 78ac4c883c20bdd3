"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import forget, materialize, scratch_path, ship_package

__all__ = ["crc_fold", "forget", "held_out", "hash_order", "keep_table", "read_table", "scratch_path", "ship_package", "slices", "small_batches", "texts", "words"]

FOLDS = 5
BATCH = 1024  # rows of a batch that the JVM hands to a worker in the pipeline
SLICE = 512  # rows whose texts a worker holds as Python objects at once


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once to the shared folder and read it back; survives lost executors."""
    return materialize(df, name)


def crc_fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string")) % F.lit(FOLDS)


def held_out(column: str = "doc_id"):
    """Rows that no model may learn a label from."""
    return F.coalesce(crc_fold(column) == 0, F.lit(False))


def hash_order(column: str = "doc_id"):
    """A fixed order that follows neither ids nor sources."""
    return F.xxhash64(F.col(column).cast("string"), F.lit(17))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have at most `BATCH` rows from now on in this session; a smaller number stays. Ten thousand whole texts in one are some 40 MB in the
    JVM's own memory beside its heap, for each task, and again in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH:
        spark.conf.set(name, str(BATCH))


def slices(batches: Iterable[pa.RecordBatch | pa.Array]) -> Iterator[pa.RecordBatch | pa.Array]:
    """Batches in slices of at most `SLICE` rows. Spark's have 10,000, whose texts and results as Python objects are several times the batch."""
    for batch in batches:
        for start in range(0, len(batch) if isinstance(batch, pa.Array) else batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column of a batch as Python strings; null reads as empty."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at blank, tab, line feed, vertical tab, form feed and return."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []

