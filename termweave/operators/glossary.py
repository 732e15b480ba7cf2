"""Glossary: cleaning the sheet, matching terms in units, verifying translations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.text import casefolded
from termweave.operators._settled import settled

# Endings that an inflected term may have.
SUFFIXES = ("", "e", "en", "er", "es", "n", "s")
#: Rows up to which a sheet's word forms are broadcast; larger sheets are joined by shuffle.
BROADCAST_TERMS = 100_000


def checked(sheet: DataFrame) -> DataFrame:
    """``sheet`` (row, source, target) with issue: empty_cell, duplicate, conflict or null; rows without both are dropped."""
    rows = sheet.withColumn("source", F.trim(F.coalesce("source", F.lit("")))).withColumn("target", F.trim(F.coalesce("target", F.lit("")))).where("source <> '' or target <> ''")
    whole = (F.col("source") != "") & (F.col("target") != "")
    group = Window.partitionBy(whole, casefolded(F.col("source")))
    targets = F.size(F.collect_set("target").over(group))
    issue = F.when(~whole, "empty_cell").when(targets > 1, "conflict").when(F.min("row").over(group) < F.col("row"), "duplicate")
    return rows.withColumn("issue", issue)


def word_forms(terms: DataFrame) -> DataFrame:
    """row, form: each single-word term with every ending, case folded."""
    return terms.select("row", F.explode(F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(casefolded(F.col("source")), s))).alias("form"))


def target_pattern(term: Column, compound: bool) -> Column:
    """A pattern for a term as it stands in a text: any case, with an ending or not; a compound word may end with it."""
    literal = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit("(?iuU)" + ("" if compound else r"(?<!\w)")), literal, F.lit("(?:" + "|".join(s for s in SUFFIXES if s) + r")?(?!\w)"))


def match_words(units: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, unit_idx, row, n: how often each single-word term stands in each unit, inflected or not.

    Words of the units meet the terms' forms by an equi join, so no unit is tried against every term.
    """
    forms = word_forms(terms).distinct()
    forms = F.broadcast(forms) if forms.count() <= BROADCAST_TERMS else forms
    words = units.select("doc_id", "unit_idx", F.explode(F.regexp_extract_all(casefolded(F.col("text")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("form"))
    return words.join(forms, "form").groupBy("doc_id", "unit_idx", "row").agg(F.count("*").alias("n"))


def missed_terms(matches: DataFrame, answers: DataFrame, terms: DataFrame, compound: bool = False) -> DataFrame:
    """doc_id, unit_idx, row: ``matches`` (doc_id, unit_idx, row, n) whose target stands fewer than n times in the answer.

    ``answers`` have doc_id, unit_idx, text, ``terms`` row and target. Targets of any number of words count in any case,
    inflected or not; if ``compound``, at the end of longer words, too. Each target counts by itself: none claims a place.
    A null answer misses all.
    """
    joined = matches.join(_small(terms.select("row", "target"), terms.count()), "row").join(answers.select("doc_id", "unit_idx", "text"), ["doc_id", "unit_idx"])
    found = F.regexp_count("text", target_pattern(F.col("target"), compound))
    return joined.where(F.coalesce(found, F.lit(0)) < F.col("n")).select("doc_id", "unit_idx", "row")


def misses(matches: DataFrame, answers: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, unit_idx, row: matched terms whose target stands fewer times in the answer than the term in the unit."""
    found = match_words(answers, targets).withColumnRenamed("n", "m")
    joined = matches.join(found, ["doc_id", "unit_idx", "row"], "left")
    return joined.where(F.coalesce("m", F.lit(0)) < F.col("n")).select("doc_id", "unit_idx", "row")


def winners(unit: np.ndarray, at: np.ndarray, end: np.ndarray, chars: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which finds (places at .. end - 1 of a unit) stay, where in each unit longer terms, smaller rows, earlier places claim first.

    A find that meets no other one stays; only contested ones are tried in order, each against the places that are taken.
    """
    if not len(at):
        return np.zeros(0, bool)
    span = int(end.max()) + 1
    begin, stop = unit * span + at, unit * span + end
    order = np.argsort(begin, kind="stable")
    reach = np.maximum.accumulate(stop[order])
    met = np.zeros(len(at), bool)
    met[1:] = begin[order][1:] < reach[:-1]
    met[:-1] |= begin[order][1:] < stop[order][:-1]
    keep = np.ones(len(at), bool)
    contested = order[met]
    if len(contested):
        last = np.zeros(int(unit.max()) + 1, np.int64)
        np.maximum.at(last, unit, end)
        now, taken = -1, bytearray()
        for i in contested[np.lexsort((at[contested], row[contested], -chars[contested], unit[contested]))].tolist():
            if unit[i] != now:
                now, taken = unit[i], bytearray(int(last[unit[i]]))
            a, e = int(at[i]), int(end[i])
            if taken.find(1, a, e) < 0:
                taken[a:e] = b"\x01" * (e - a)
            else:
                keep[i] = False
    return keep


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units' finds to row and n, in Arrow batches: what a place is claimed by depends on all claims before."""
    for batch in batches:
        lists = batch.column(2)
        unit = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        at, end, chars, row = (np.asarray(x, np.int64) for x in lists.flatten().flatten())
        keep = winners(unit, at, end, chars, row)
        pairs, n = np.unique(np.stack([unit[keep], row[keep]]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0])), batch.column(1).take(pa.array(pairs[0])), pa.array(pairs[1].astype(np.int32)), pa.array(n.astype(np.int64))], ["doc_id", "unit_idx", "row", "n"])


def _cut(text: Column) -> Column:
    """Case-folded words and what stands between them, in turn."""
    return F.regexp_extract_all(casefolded(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def _first_words(units: DataFrame, forms: DataFrame, compound: bool) -> DataFrame:
    """``forms`` with word: what words of the units begin a form; if ``compound``, those that end with its first word, too.

    Each distinct word gives its endings of only those lengths that first words have, so rows grow with the distinct
    words and lengths, not with words times terms.
    """
    if not compound:
        return forms.withColumn("word", F.col("token"))
    lengths = sorted(r["n"] for r in forms.select(F.char_length("token").alias("n")).distinct().collect())
    words = units.select(F.explode(F.regexp_extract_all(casefolded(F.col("text")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).distinct()
    endings = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("word"))
    ended = words.withColumn("n", F.explode(endings)).select("word", F.expr("right(word, n)").alias("token"))
    whole = forms.where(~F.col("token").rlike(r"[\p{L}\p{N}_]")).withColumn("word", F.col("token"))
    return ended.join(_small(forms, forms.count()), "token").unionByName(whole, allowMissingColumns=True)


def _ended(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """``tokens`` (doc_id, unit_idx, all) that ``forms`` begin at, also at the end of a longer word: doc_id, unit_idx, at, row, chars, rest.

    Each token gives its endings of only those lengths that first words have, where it stands; they meet the forms, which
    are sent to all tasks. So nothing grows with the distinct words of the texts, and no place is shuffled.
    """
    lengths = F.array(*[F.lit(r["n"]) for r in forms.select(F.char_length("token").alias("n")).distinct().collect()]).cast("array<int>")
    placed = tokens.select("doc_id", "unit_idx", "all", F.posexplode("all").alias("at", "word"))
    sized = placed.withColumn("size", F.char_length("word")).withColumn("is_word", F.col("word").rlike(r"^[\p{L}\p{N}_]"))
    # what stands between words must be a term's mark as a whole
    ends = sized.withColumn("n", F.explode(lengths)).where((F.col("n") == F.col("size")) | ((F.col("n") < F.col("size")) & F.col("is_word")))
    met = ends.withColumn("token", F.expr("right(word, n)")).join(F.broadcast(forms), "token")
    return met.where(F.slice("all", F.col("at") + 2, F.size("rest")) == F.col("rest")).select("doc_id", "unit_idx", "at", "row", "chars", "rest")


def match_terms(units: DataFrame, terms: DataFrame, compound: bool = False) -> DataFrame:
    """doc_id, unit_idx, row, n: occurrences of ``terms`` (row, source) of one or more words in ``units``, longer ones first.

    The last word may be inflected; if ``compound``, the first may be the end of a longer word (Anlagenfreigabe). A place
    in a text meets the terms that begin so by an equi join. Of overlapping finds the longest term stays, then the one
    with the smaller row, then the earlier place. Empty terms are ignored, and so are units without a text; terms that
    begin or end with a mark need just this mark there. Rows of one unit (doc_id and unit_idx, null too) are one unit.
    """
    forms = word_forms(terms.where("length(source) > 0").select("row", "source")).distinct().join(terms.select("row", F.char_length("source").alias("chars")), "row")
    forms = settled(forms.withColumn("want", _cut(F.col("form"))).select("row", "chars", F.element_at("want", 1).alias("token"), F.slice("want", F.lit(2), F.size("want")).alias("rest")).distinct())
    longest = forms.agg(F.coalesce(F.max(F.size("rest")), F.lit(0)).alias("n")).first()["n"]
    tokens = units.select("doc_id", "unit_idx", _cut(F.col("text")).alias("all"))
    if compound and forms.count() <= BROADCAST_TERMS:
        met = _ended(tokens, forms)
    else:
        begins = settled(_first_words(units, forms, compound).select("word", "row", "chars", "rest"))
        place = F.transform("all", lambda t, i: F.struct(i.alias("at"), t.alias("word"), F.slice("all", i + 2, F.lit(longest)).alias("next")))
        places = tokens.select("doc_id", "unit_idx", F.explode(place).alias("p"))
        met = places.select("doc_id", "unit_idx", "p.at", "p.word", "p.next").join(_small(begins, begins.count()), "word").where(F.slice("next", F.lit(1), F.size("rest")) == F.col("rest"))
    find = F.struct("at", (F.col("at") + F.size("rest") + 1).alias("end"), "chars", "row")
    finds = met.groupBy("doc_id", "unit_idx").agg(F.collect_set(find).alias("finds"))
    kinds = [f"{c} {units.schema[c].dataType.simpleString()}" for c in ("doc_id", "unit_idx")]
    return finds.mapInArrow(_claims, ", ".join([*kinds, "row int", "n bigint"]))
