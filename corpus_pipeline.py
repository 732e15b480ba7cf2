"""The corpus pipeline: quality rules, near duplicates, personal data, mixing and packing, each over what the last kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import mixing, ngram_join, packing, pii, quality_rules, tokens
from termweave.llm._store import shared_dir
from termweave.llm.queries import SURROGATE_KEY


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, so that names of its columns meet no others, with its key: doc_id (null apart) and text."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))


KEY = ["no_id", "id", "hash"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail the base rules and go; equal rows go alike; rows of
    one doc_id are judged each by its own text; an empty table gives no rows; extra columns stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.quality(docs.select("doc_id", "text"), quality_rules.trusted_documents(labels)).where("kept")
    kept = judged.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("_text_hash").alias("hash")).distinct()
    return _rows(docs).join(kept, KEY, "left_semi").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links by shingles: that of the least doc_id (none is last), then text hash.

    Rows that share a doc_id are judged each by its own text. Rows without words link with nothing and stay. Of equal
    keys the least row stays. An empty table gives no rows; extra columns stay.
    """
    rows = ngram_join.row_components(docs).where("component is not null")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))
    first = rows.groupBy("component").agg(F.min(key).alias("key")).select("key.*")
    worded = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = _rows(docs).where(worded).join(first, KEY).groupBy(*KEY).agg(F.min("row").alias("row"))
    return one.select("row.*").unionByName(_rows(docs).where(~worded).select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    replaced = pii.replace_pii(docs, SURROGATE_KEY).drop("n_mentions")
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order.

    Rows with one doc_id and text are taken each, as the least of them. Null texts are documents of
    no words; null sources are one source; an empty table gives no rows; extra columns stay.
    """
    light = docs.select("doc_id", "source", F.xxhash64("text").alias("_hash"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_size"))
    mixed = mixing.mix(light, F.col("_size"))
    places = mixing.in_training_order(mixed, ["doc_id", "_hash"]).withColumnRenamed("doc_id", "_id")
    placed = places.select(F.col("_id").isNull().alias("no_id"), F.coalesce(F.col("_id").cast("long"), F.lit(0)).alias("id"), F.col("_hash").alias("hash"), "position")
    one = _rows(docs).groupBy(*KEY).agg(F.min("row").alias("row"))
    return one.join(placed, KEY).repartitionByRange("position", "id").sortWithinPartitions("position", "id").select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into token sequences."""
    return packing.pack_documents(docs, tokens.default_vocabulary())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

#: Hashed weights, keyed surrogates and a tokenizer are beyond SQL; tests run every stage on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/termweave/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
