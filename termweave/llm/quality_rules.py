"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

DataFrame functions only. Words and pairs of words are hashed to a fixed number of buckets. Two multinomials over the
buckets are estimated: the raw corpus from all documents, the trusted target from labelled good ones. A document's score
is the mean over its n-grams of log(target / raw), and a fixed threshold decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

#: Buckets of words and as many of word pairs; the table of weights has one row of two numbers for each bucket.
BUCKETS = 1 << 16
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.25
#: The target's prior: so many n-grams dealt as the raw corpus has them.
PRIOR = 65_536.0


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (column text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A word counts as repeated if a window of three words over it occurs twice or more in its text: windows are sorted by
    hash to find those that do, then sorted by place, and each adds up to three words until the next one starts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.withColumn("_words", words_of(F.col("text")))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_threes", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))))
        .drop("_words", "_lines")
    )
    repeats = F.size(F.array_distinct("_threes")) < F.size("_threes")
    placed = counted.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_threes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_threes")
    again = F.filter("_pairs", lambda p, k: (p["h"] == F.get("_pairs", k - 1)["h"]) | (p["h"] == F.get("_pairs", k + 1)["h"]))
    placed = placed.withColumn("_at", F.sort_array(F.transform(again, lambda p: p["i"]))).drop("_pairs")
    new = F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - x, F.lit(3))))
    n_repeat = F.coalesce(F.aggregate(new, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return placed.withColumn("n_repeat_words", n_repeat).withColumn("base_failed", failed).drop("_at")


def ngram_buckets(words: Column, count: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words, then of all pairs of neighbours (numbered from ``buckets``), as an array of ints."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.when(count >= 2, F.transform(F.sequence(F.lit(0), count - 2), lambda i: (F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(buckets)) + buckets).cast("int")))
    return F.concat(single, F.coalesce(pairs, F.array().cast("array<int>")))


def _grams(docs: DataFrame, *keys: str) -> DataFrame:
    # explode_outer: explode would infer a filter on the array, which the optimizer moves down and splits the text for each n-gram
    words = docs.withColumn("_words", words_of(F.col("text"))).drop("text")
    return words.withColumn("_grams", ngram_buckets(F.col("_words"), F.size("_words"))).select(*keys, F.explode_outer("_grams").alias("bucket"))


def ratio_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, weight: log(target / raw) for every bucket that the corpus has; at most two rows for each of BUCKETS.

    ``trusted`` has doc_id of good documents; the target counts all of them, raw counts all documents.
    """
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("_key")).distinct().withColumn("good", F.lit(1))
    # texts move once, at any size, and are cut once for both counts; rows without an id are dealt by their text and meet none
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_key"))
    marked = keyed.join(ids.hint("shuffle_hash"), "_key", "left").select("text", F.when(F.col("doc_id").isNotNull(), F.col("good")).alias("good"))
    grams = _grams(marked, "good")
    counts = grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    kind = counts.withColumn("pair", F.col("bucket") >= BUCKETS)
    totals = kind.groupBy("pair").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = F.col("raw") / F.col("all_raw")
    target = (F.col("target") + PRIOR * share) / (F.col("all_target") + PRIOR)
    return kind.join(F.broadcast(totals), "pair").select("bucket", F.log(target / share).alias("weight"))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) judged: doc_id, _text_hash, the base counts, base_failed, score and kept.

    ``trusted`` (doc_id) names documents of the target. kept is false if base_failed, else whether the mean ratio is at
    least ``threshold``. A null or empty text has no words, fails the base rules and scores 0. Rows with a null doc_id
    are judged by their text; rows that repeat a doc_id are told apart by their text. Without trusted documents every
    ratio is 0. An empty table gives no rows.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_text_hash", F.xxhash64("text"))
    weights = F.broadcast(ratio_weights(docs, trusted))
    scored = _grams(own, "doc_id", "_text_hash").join(weights, "bucket").groupBy("doc_id", "_text_hash").agg((F.sum("weight") / F.count("*")).alias("score"))
    base = base_counts(own).drop("text")
    matched = base.join(scored.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text_hash", "_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    score = F.round(F.coalesce("score", F.lit(0.0)), 9)
    # a table of its own: a later filter on kept, moved down, would repeat the counts for each word
    return written(matched.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)), "judged")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_id of the labelled documents of good quality that aren't toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
