"""Documents as ordered tables: blocks from lines, events from logs, text from bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The usage log's columns; open-ended extra fields of an event are not read.
EVENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("ts", "event", "user", "session", "model", "source", "target", "file_type", "status", "format")]
    + [T.StructField("size_kb", T.DoubleType()), T.StructField("glossary_terms", T.LongType()), T.StructField("duration_s", T.DoubleType()), T.StructField("failed_blocks", T.LongType())]
)


def line_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx, kind, text: a block for each line; the first is a heading, lines with ' | ' are tables."""
    line = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_idx", "text"))
    kind = F.when(F.col("block_idx") == 0, "heading").when(F.contains("text", F.lit(" | ")), "table").otherwise("paragraph")
    return line.select("doc_id", "block_idx", kind.alias("kind"), "text")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, white space collapsed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def text_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx, text: ``paragraphs`` of each document."""
    return docs.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("block_idx", "text"))


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines log; malformed lines are left out."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark where valid, else Windows-1252 (bytes that it lacks become U+FFFD)."""
    text = content.cast("string")
    upper = bytes(range(0x80, 0xA0))
    western = F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin-1"), upper.decode("cp1252", "replace"))
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).otherwise(western)


def usage_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as usage events: pos, ts (ISO with offset), event, user, status, duration_s, format."""
    kinds = {"signup": "login_ok", "click": "job_start", "purchase": "job_end", "view": "download", "error": "login_failed"}
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    is_end = F.col("event_type") == "purchase"
    return events.select(
        F.col("event_id").alias("pos"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("ts"),
        event.alias("event"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user"),
        F.when(is_end, F.when(k % 10 == 0, "error").otherwise("ok")).alias("status"),
        F.when(is_end, F.col("value")).alias("duration_s"),
        F.when(F.col("event_type") == "view", F.element_at(F.array(*[F.lit(x) for x in ("md", "docx", "pdf", "csv")]), k % 4 + 1)).alias("format"),
    )
