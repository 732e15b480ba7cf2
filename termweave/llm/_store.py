"""Tables written to the folder that the cluster shares, and how many partitions a table deserves."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='termweave-')}"
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    return named.rstrip("/")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and lost executors cost no rework before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/termweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing still to be run reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
