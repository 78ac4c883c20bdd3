"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SPREAD = "spark.sieveline.spread"


def local_session(app: str = "sieveline", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-node benches; on a cluster the submitter makes the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config(SPREAD, "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder; a cluster gets an error, because a folder of one machine would be lost or
    unseen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sieveline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write a DataFrame once to the shared folder and read it back.

    Used where several jobs go over the same derived rows (fold loops, iterative fits). A written
    table survives the loss of executors, which a cache or a local checkpoint does not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables) -> None:
    """Delete tables that `materialize` wrote, when nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def spread(df):
    """Deal a table out to all cores, if the session asks for it.

    A file of one row group is one task, and text work is bound by CPU; on one machine with such files a shuffle pays.
    ``local_session`` asks for it. A cluster leaves the setting unset, and the table is read as it is split.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get(SPREAD, "false") == "true" else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver was started.

    Does nothing if it was done before for this context, or if the package was already sent with
    the job (``--py-files``) and so lies in an archive.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_sieveline_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="sieveline-")) / "sieveline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sieveline_shipped = True
