"""Structured Streaming: triage of arriving messages and an embedding job that can be resumed.

Both are stateless projections. Exactly-once output comes from the file sink and the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _source(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The folder to watch and the file name to look for: a table is a folder of files, or one file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        raise FileNotFoundError(path)
    if files.getFileStatus(target).isDirectory():
        return path, None
    return target.getParent().toString(), "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in target.getName())


def message_stream(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """Files of the table at ``path`` (a folder, or one file) as they arrive. A table that is not there is an error."""
    path, glob = _source(spark, path)
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def run_stream(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to parquet files. ``once`` takes what is there now and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run to the end of the available input and read the sink."""
    run_stream(stream, out, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_project(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    project: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    max_files: int | None = None,
) -> DataFrame:
    """Apply a narrow projection, the same one as in batch, to files as they arrive.

    Started again with the same checkpoint after a stop or a lost executor, it goes on behind the
    last committed batch: nothing is done twice and nothing is left out.
    """
    return drain(project(message_stream(spark, path, schema, max_files)), out, checkpoint)


def committed_rows(spark: SparkSession, out: str, schema: T.StructType | str) -> int:
    """Rows of the batches that a sink has committed so far; 0 before the first."""
    try:
        return spark.read.schema(schema).parquet(out).count()
    except AnalysisException:  # no folder yet
        return 0
