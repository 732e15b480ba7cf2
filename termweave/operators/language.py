"""Language identification by character trigrams, profiles counted by Spark.

Texts are cut to trigrams in Arrow batches, with numpy over many texts at once: what leaves a batch are its sums, not a
row for each character.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trigrams of a language that its profile keeps: the most frequent ones.
PROFILE = 300
#: Trigrams up to which a table of them is sent to all tasks; with more, texts meet it by a join.
SENT_GRAMS = 300_000
#: Characters that are cut at once.
_CHUNK = 1 << 19


def _lowered(prefix: int | None) -> Column:
    whole = F.coalesce("text", F.lit(""))
    return F.lower(whole if prefix is None else F.substring(whole, 1, prefix))


def _chunks(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of texts: each trigram as a number of three code points, and the place of its text, in parts of some ``_CHUNK``."""
    held: list[tuple[int, str]] = []
    size = 0

    def cut() -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(held)), [len(t) for _, t in held])
        whole = owner[2:] == owner[:-2]
        grams = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[whole]
        return grams, np.array([n for n, _ in held])[owner[2:][whole]]

    for n, text in enumerate(texts):
        for start in range(0, max(1, len(text) - 2), _CHUNK):
            part = text[start : start + _CHUNK + 2]
            held.append((n, part))
            size += len(part)
            if size >= _CHUNK:
                yield cut()
                held, size = [], 0
    if size > 2:
        yield cut()


def _number(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _gram(number: int) -> str:
    return chr(number >> 42) + chr(number >> 21 & 0x1FFFFF) + chr(number & 0x1FFFFF)


def trigrams(docs: DataFrame, prefix: int | None = 2000) -> DataFrame:
    """doc_id and gram for every three characters of the first ``prefix`` (None: of all), lower case."""
    whole = F.coalesce("text", F.lit(""))
    text = F.lower(whole if prefix is None else F.substring(whole, 1, prefix))
    # characters are cut once; from a text's start each trigram would be found anew
    def cut(characters):
        return F.transform(F.sequence(F.lit(0), F.size(characters) - 3), lambda i: F.concat(characters[i], characters[i + 1], characters[i + 2]))

    grams = F.get(F.transform(F.array(F.split(text, "")), lambda t: F.when(F.size(t) >= 3, cut(t))), F.lit(0))
    return docs.withColumn("_g", F.when(F.length(text) >= 3, grams)).select(*[c for c in docs.columns if c != "text"], F.explode("_g").alias("gram"))


def profiles(docs: DataFrame) -> DataFrame:
    """lang, gram, n, rank: the most frequent trigrams of each language's whole texts (ties by gram)."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return gram_counts(docs).withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "gram", "n", "rank")


class Sent(NamedTuple):
    """What judges texts in a task: a language's score sums its column of ``weights`` over a text's trigrams, and ``each`` for every trigram."""

    langs: list[str]
    #: Known trigrams in order, and a row of weights for each.
    known: np.ndarray
    weights: np.ndarray
    each: list[float]
    #: Whether texts none of whose trigrams is known have no language.
    seen: bool


def _to_send(langs: list[str], grams: dict[str, list[float]], each: list[float], seen: bool) -> Sent:
    numbers = np.array([_number(g) for g in grams], np.int64)
    order = np.argsort(numbers)
    return Sent(langs, numbers[order], np.array(list(grams.values()), float).reshape(len(numbers), len(langs))[order], each, seen)


def _found(texts: Iterable[str], size: int, sent: Sent) -> list[str | None]:
    """The language of the highest score of each of ``size`` texts, ties to the least code; those without trigrams have none."""
    langs, known, weights, each, seen = sent
    scores, n, hits = np.zeros((size, len(langs))), np.zeros(size), np.zeros(size)
    for found, owner in _chunks(texts):
        n += np.bincount(owner, minlength=size)
        if len(known):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            here = known[at] == found
            at, owner = at[here], owner[here]
            hits += np.bincount(owner, minlength=size)
            for i in range(len(langs)):
                scores[:, i] += np.bincount(owner, weights=weights[at, i], minlength=size)
    total = np.round(scores + n[:, None] * np.array(each), 6)
    judged = (hits if seen else n) > 0
    return [langs[i] if ok else None for i, ok in zip(total.argmax(axis=1), judged)] if langs else [None] * size


def _judged(docs: DataFrame, prefix: int | None, sent: Sent) -> DataFrame:
    """doc_id, lang for every row."""
    table = docs.sparkSession.sparkContext.broadcast(sent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts become strings one at a time, and go with their chunk
            best = _found((text.as_py() for text in batch.column(1)), batch.num_rows, table.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], ["doc_id", "lang"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _lowered(prefix).alias("text")).mapInArrow(task, f"doc_id {kind}, lang string")


def judged_lists(rows: DataFrame, texts: Column, sent: Sent) -> DataFrame:
    """``rows`` with langs: the language of each of ``texts`` (an array; of each the first 2,000 characters count), in place."""
    table, names = rows.sparkSession.sparkContext.broadcast(sent), [*rows.columns, "langs"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            best = pa.array(_found((text.as_py() or "" for text in flat), len(flat), table.value), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)], names)

    asked = F.transform(texts, lambda t: F.lower(F.substring(t, 1, 2000)))
    return rows.withColumn("_asked", asked).mapInArrow(task, T.StructType([*rows.schema.fields, T.StructField("langs", T.ArrayType(T.StringType()))]))


def detect(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, lang for every row: the language whose profile's grams a text uses most often (ties: least code), null if none.

    ``profile`` has ``PROFILE`` grams a language at most, so it is sent to all tasks.
    """
    rows = profile.select("lang", "gram").collect()
    langs = sorted({r["lang"] for r in rows})
    grams: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(langs))
    for r in rows:
        grams[r["gram"]][langs.index(r["lang"])] = 1.0
    return _judged(docs, 2000, _to_send(langs, grams, [0.0] * len(langs), True))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each language's whole texts use each trigram; texts without a language don't count.

    A batch sends a row for each trigram and language that it holds.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, code = np.unique(batch.column(0).to_pylist(), return_inverse=True)
            for found, owner in _chunks(text.as_py() for text in batch.column(1)):
                for i, lang in enumerate(langs):
                    grams, n = np.unique(found[code[owner] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(grams), pa.string()), pa.array([_gram(g) for g in grams.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    cut = docs.where("lang is not null").select("lang", _lowered(None).alias("text")).mapInArrow(task, "lang string, gram string, n bigint")
    return cut.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def detect_bayes(docs: DataFrame, counts: DataFrame, prefix: int | None = 2000) -> DataFrame:
    """doc_id, lang for every row: multinomial naive Bayes over trigrams, ``counts`` smoothed by 0.5, all languages alike.

    Ties go to the least code; a text without trigrams has none. Of a text the first ``prefix`` characters are judged.
    A language's score is that of unseen trigrams alone, and what each trigram that it has seen adds to it.
    """
    sent = sent_counts(counts)
    return _joined_bayes(docs, counts, prefix) if sent is None else _judged(docs, prefix, sent)


def sent_counts(counts: DataFrame) -> Sent | None:
    """``counts`` as they are sent to all tasks; None where they are too many."""
    rows = counts.select("lang", "gram", "n").limit(SENT_GRAMS + 1).collect()
    if len(rows) > SENT_GRAMS:
        return None
    langs = sorted({r["lang"] for r in rows})
    grams: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(langs))
    totals = dict.fromkeys(langs, 0)
    for r in rows:
        grams[r["gram"]][langs.index(r["lang"])] = math.log(2 * r["n"] + 1)
        totals[r["lang"]] += r["n"]
    return _to_send(langs, grams, [math.log(0.5 / (totals[x] + len(grams) / 2)) for x in langs], False)


def _joined_bayes(docs: DataFrame, counts: DataFrame, prefix: int | None) -> DataFrame:
    """``detect_bayes`` where the counts are too many to be sent: trigrams of the texts meet them by a join."""
    distinct = counts.agg(F.count_distinct("gram").alias("distinct"))
    unseen = counts.groupBy("lang").agg(F.sum("n").alias("all")).crossJoin(distinct).select("lang", F.log(F.lit(0.5) / (F.col("all") + F.col("distinct") / 2)).alias("unseen"))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    grams = trigrams(keyed.select("_key", "text"), prefix).groupBy("_key", "gram").agg(F.count("*").alias("c"))
    seen = grams.join(counts, "gram").groupBy("_key", "lang").agg(F.sum(F.col("c") * F.log(2 * F.col("n") + 1)).alias("seen"))
    scores = grams.groupBy("_key").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(unseen)).join(seen, ["_key", "lang"], "left")
    score = F.round(F.col("c") * F.col("unseen") + F.coalesce("seen", F.lit(0.0)), 6)
    best = scores.groupBy("_key").agg(F.min(F.struct((-score).alias("score"), "lang"))["lang"].alias("lang"))
    return keyed.select("doc_id", "_key").join(best, "_key", "left").select("doc_id", "lang")


#: Shortest text whose language counts.
MIN_CHARS = 40


def is_in_language(texts: DataFrame, counts: DataFrame, lang: str) -> DataFrame:
    """doc_id, in_language for every row of ``texts`` (doc_id, text): 40 characters or more that read as ``lang``."""
    long = F.coalesce(F.length("text") >= MIN_CHARS, F.lit(False))
    found = detect_bayes(texts.select(F.struct("doc_id", long.alias("long")).alias("doc_id"), "text"), counts, None)
    return found.select("doc_id.doc_id", (F.col("doc_id.long") & F.coalesce(F.col("lang") == lang, F.lit(False))).alias("in_language"))


def looks_untranslated(pairs: DataFrame, counts: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """doc_id, untranslated for pairs (doc_id, source, output; a row for each doc_id).

    Sources of 40 characters or more whose output is the same but for white space, or still reads as the source
    language. With one language for both nothing is untranslated.
    """
    if source_lang == target_lang:
        return pairs.select("doc_id", F.lit(False).alias("untranslated"))
    long = F.length("source") >= MIN_CHARS
    found = detect_bayes(pairs.where(long).select("doc_id", F.col("output").alias("text")), counts).select("doc_id", F.col("lang").alias("found"))
    untranslated = long & (same_words(F.col("source"), F.col("output")) | F.coalesce(F.col("found") == source_lang, F.lit(False)))
    return pairs.join(found, "doc_id", "left").select("doc_id", F.coalesce(untranslated, F.lit(False)).alias("untranslated"))


def same_words(source: Column, output: Column) -> Column:
    """Whether two texts are the same but for white space."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return plain(source) == plain(output)


def _sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"</?(?:a[0-9]+|b|i|u)>", ""), r"(?<=[.!?])\s+|\n+")


def long_sentences(text: Column) -> Column:
    """Sentences of 40 characters or more."""
    return F.filter(_sentences(text), lambda s: F.length(s) >= MIN_CHARS)


def has_source_sentence(texts: DataFrame, counts: DataFrame, lang: str) -> DataFrame:
    """doc_id, has_sentence for texts (doc_id, text; a row for each doc_id): a sentence of 40 characters or more in ``lang``."""
    each = texts.select("doc_id", F.posexplode(_sentences(F.col("text"))).alias("at", "text")).where(F.length("text") >= MIN_CHARS)
    found = detect_bayes(each.select(F.struct("doc_id", "at").alias("doc_id"), "text"), counts).where(F.col("lang") == lang)
    hits = found.select(F.col("doc_id.doc_id").alias("doc_id")).distinct().withColumn("has_sentence", F.lit(True))
    return texts.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("has_sentence", F.lit(False)).alias("has_sentence"))
