"""Importance resampling towards a target distribution, by hashed features.

Each document's features become bucket numbers by higher-order functions and are kept as one array; a document's score
sums a literal array of gains over them. Nothing is exploded to score, and only counts by bucket or by score shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text: digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(WORD), F.lit(0))


def _runs(found: Column, size: int) -> Column:
    starts = F.when(F.size(found) >= size, F.sequence(F.lit(1), F.size(found) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.array_join(F.slice(found, at, size), " "))


def buckets(docs: DataFrame, text: str, longest: int, n_buckets: int, *columns: str) -> DataFrame:
    """``columns``, n_words and buckets: a bucket (short) for each run of 1 to ``longest`` words of ``text``."""
    bucket = lambda feature: (F.crc32(feature) % n_buckets).cast("short" if n_buckets <= 1 << 15 else "int")

    def of(found: Column) -> Column:
        features = found if longest == 1 else F.flatten(F.array(found, *[_runs(found, n) for n in range(2, longest + 1)]))
        return F.struct(F.size(found).cast("long").alias("n_words"), F.transform(features, bucket).alias("buckets"))

    # words are cut once: a lambda over them would cut them anew for each run
    return docs.select(*columns, F.get(F.transform(F.array(words(F.col(text))), of), F.lit(0)).alias("_f")).select(*columns, "_f.n_words", "_f.buckets")


def _counts(hashed: DataFrame) -> dict[int, int]:
    """Features by bucket: summed in each task first, so each task sends as many rows as there are buckets, at most."""
    rows = hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    return {row["bucket"]: row["n"] for row in rows}


def gains(raw: dict[int, int], target: dict[int, int], n_buckets: int) -> list[int]:
    """For each bucket 1000 times the log ratio of its smoothed shares in target and raw features, rounded down."""
    all_raw, all_target = sum(raw.values()) + n_buckets, sum(target.values()) + n_buckets
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * float(all_raw) / ((raw.get(b, 0) + 1) * float(all_target)))) for b in range(n_buckets)]


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, n_buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text) against ``target`` (text).

    weight is the floored mean gain of a document's features (none: 0); score adds Gumbel noise keyed by ``seed`` and
    doc_id. Of the rows with ``min_words`` words or more, ``percent`` per cent with the highest scores are drawn: rank 1,
    2, 3 ... by score, then doc_id (null last); the others' rank is null. Null texts have no features. A null doc_id
    counts as the empty text in the noise. Rows of one doc_id are ranked each; equal ones in any order. Other columns
    are left out. An empty table gives no rows; an empty target leaves all buckets at their smoothed share.

    Scores are whole numbers within some 10^5 (logarithms of counts, and noise of 32 bits), so the table of rows by
    score that the cut is found from is bounded; only rows above the cut are ordered, each score apart.
    """
    hashed = written(buckets(docs, "text", longest, n_buckets, "doc_id"), "feature-buckets")
    found = gains(_counts(hashed), _counts(buckets(target, "text", longest, n_buckets)), n_buckets)
    table = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b.cast("int") + 1))
    n = F.size("buckets").cast("long")
    weight = F.when(n > 0, F.floor((total - F.pmod(total, n)) / n)).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = hashed.select("doc_id", n.alias("n_features"), weight.alias("weight"), noise.alias("noise"), (F.col("n_words") >= min_words).alias("enough"))
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "enough"), "importance")

    by_score = scored.where("enough").groupBy("score").agg(F.count("*").alias("n")).collect()
    missing = percent * sum(row["n"] for row in by_score) // 100
    before, above = [], 0
    for row in sorted(by_score, key=lambda r: -r["score"]):
        if above >= missing:
            break
        before.append((row["score"], above))
        above += row["n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "score long, above long"))
    # every row keeps its score's window apart: noise spreads even equal texts over some thousand scores
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    place = F.col("above") + within
    ranked = scored.where("enough").join(starts, "score").select("doc_id", "n_features", "weight", "score", F.when(place <= missing, place).alias("rank"))
    rest = scored.join(starts, "score", "left").where("not enough or above is null")
    return ranked.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
