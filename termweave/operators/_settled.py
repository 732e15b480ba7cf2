"""Cutting the lineage of tables that rounds build on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where a local session has none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='termweave-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for the tables of one job, in the shared one."""
    return f"{_checkpoint_dir(spark)}/termweave-{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end at ``path``."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table, or folder of tables, that nothing still to be run reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write(df: DataFrame, path: str) -> None:
    """``df`` as Parquet at ``path``. The files of its shuffles go when it is written, not when the driver next collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read again: filters on it reach the files."""
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
