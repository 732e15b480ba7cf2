"""The usage log as a stream, and its sinks: files that hold each event once, and counts of closed days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from termweave.sources.documents import EVENT_SCHEMA

#: An event and its number, by which events that come twice are told.
LOG_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), *EVENT_SCHEMA.fields])


def read_usage_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """New events of a folder of JSON-lines files; malformed lines have a null event and are left out."""
    return spark.readStream.schema(schema).json(path).where("event is not null")


def daily_jobs(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, user, value: jobs started a day; events later than ``late`` behind the newest are dropped."""
    timed = events.where("event = 'job_start'").withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "user").agg(F.count("*").alias("value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "user", "value")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """``events`` (event_id, ts, ...) without those whose event_id came before, with day, as the log has it.

    An event that comes again within ``late`` is known by its number, which is kept so long and no longer; what is later
    than that behind the newest event is dropped. Events without a number or a readable time are dropped.
    """
    timed = events.withColumn("_at", F.try_to_timestamp("ts")).where("_at is not null and event_id is not null")
    return timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("_at").withColumn("day", F.left("ts", F.lit(10)))


def to_files(df: DataFrame, path: str, checkpoint: str, by: str = "day") -> StreamingQuery:
    """Appends all that is there now to JSON-lines files at ``path``, in a folder for each value of ``by``.

    The sink's own log makes each micro-batch count once, also where it is written again after a failure; with the same
    ``checkpoint`` (a shared folder) a later start goes on where the last one ended. Null fields are left out.
    """
    return df.writeStream.outputMode("append").format("json").partitionBy(by).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_events(spark: SparkSession, incoming: str, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends the new events of the folder ``incoming`` to the log at ``path``, each once."""
    return to_files(once(read_usage_stream(spark, incoming, LOG_SCHEMA), late), path, checkpoint)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The events that a sink has committed, with day."""
    return spark.read.schema(T.StructType([*LOG_SCHEMA.fields, T.StructField("day", T.StringType())])).json(path)
