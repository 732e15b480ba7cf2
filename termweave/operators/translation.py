"""Segments on the wire, answers of a model, retries, prompts, reports and formatted runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import language
from termweave.operators._settled import settled

#: Shortest text whose return without a change counts as a failure.
MIN_CHARS = 40
#: Model calls are column expressions of a text and whether the call is strict; null: no usable answer.
Model = Callable[[Column, Column], Column]


def _in_order(order: Column, text: Column, gap: str) -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), gap)


def encoded(segmented: DataFrame) -> DataFrame:
    """doc_id, segment, n_units, wire, spans, of_line (spans of each): units as lines ``[[n]] text``, protected spans numbered through the segment."""
    before = Window.partitionBy("doc_id", "segment").orderBy("unit_idx").rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(Window.partitionBy("doc_id", "segment").orderBy("unit_idx"))
    spans = fn.protected(F.col("text"))[1]
    rows = segmented.withColumn("_n", number).withColumn("_own", spans).withColumn("_start", F.coalesce(F.sum(F.size("_own")).over(before), F.lit(0)).cast("int") + 1)
    line = F.concat(F.lit("[["), F.col("_n"), F.lit("]] "), fn.protected(F.col("text"), F.col("_start"))[0])
    own = F.sort_array(F.collect_list(F.struct("_n", "_own")))
    return rows.withColumn("_line", line).groupBy("doc_id", "segment").agg(F.count("*").alias("n_units"), _in_order(F.col("_n"), F.col("_line"), "\n").alias("wire"), F.flatten(F.transform(own, lambda x: x["_own"])).alias("spans"), F.transform(own, lambda x: F.size(x["_own"])).alias("of_line"))


def _records(raw: Column) -> Column:
    """Lines (id, text) of an answer, as ``units.wire_lines`` and ``units.last_per_run`` give them, in one array."""
    number = lambda line: F.when(F.startswith(line, F.lit("[[")), F.regexp_extract(line, r"^\[\[([0-9]+)\]\]", 1)).otherwise("")

    def parted(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda line, at: F.struct(at.alias("at"), number(line).alias("id"))), lambda m: m["id"] != "")
        numbered = F.transform(marks, lambda m: F.struct(m["at"].alias("at"), m["id"].cast("int").alias("id")))
        return fn.let(numbered, lambda ms: F.transform(F.filter(F.transform(ms, lambda m, i: reach(lines, ms, m, i)), lambda r: ~r["again"]), lambda r: record(lines, r)))

    def reach(lines: Column, marks: Column, mark: Column, i: Column) -> Column:
        following = F.get(marks, i + 1)
        return F.struct(mark["at"].alias("at"), mark["id"].alias("id"), F.coalesce(following["at"], F.size(lines)).alias("end"), F.coalesce(following["id"] == mark["id"], F.lit(False)).alias("again"))

    def record(lines: Column, r: Column) -> Column:
        own = F.transform(F.slice(lines, r["at"] + 1, r["end"] - r["at"]), lambda line: F.regexp_replace(line, r"^\[\[[0-9]+\]\] ?", ""))
        return F.struct(r["id"].alias("id"), F.trim(F.array_join(own, "\n")).alias("text"))

    return fn.let(F.split(fn.clean_answer(raw), "\n"), parted)


def decoded(segments: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, segment, texts: each unit's text of an answer (doc_id, segment, raw), its spans put back.

    Null unless the answer has exactly the lines 1 .. n in order and every line has the tokens of its own unit.
    """
    return decoded_rows(segments.join(answers.select("doc_id", "segment", "raw"), ["doc_id", "segment"], "left"))


def decoded_rows(answered: DataFrame) -> DataFrame:
    """``decoded`` of segments that have their answer (raw) in their row."""
    # lines are parted within the row, too: nothing moves
    joined = answered.withColumn("lines", _records(F.col("raw")))
    # the spans of each line, with the number of its first one
    before = F.transform("of_line", lambda n, i: F.aggregate(F.slice("of_line", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    own = F.zip_with("of_line", before, lambda n, b: F.struct(b.alias("before"), F.slice("spans", b + 1, n).alias("spans")))
    joined = joined.withColumn("own", own).withColumn("in_order", F.transform("lines", lambda x: x["id"]) == F.sequence(F.lit(1), F.col("n_units").cast("int")))
    each = F.zip_with("lines", "own", lambda x, o: F.struct(x["text"].alias("text"), o["before"].alias("before"), o["spans"].alias("spans")))
    token = lambda before, i: F.concat(F.lit("⟦P"), (before + i + 1).cast("string"), F.lit("⟧"))
    whole = F.forall("each", lambda e: F.forall(F.transform(e["spans"], lambda s, i: token(e["before"], i)), lambda t: F.contains(e["text"], t)))
    texts = F.transform("each", lambda e: fn.restored(e["text"], e["spans"], e["before"] + 1))
    return joined.withColumn("each", F.when(F.col("in_order"), each)).select("doc_id", "segment", F.when(whole, texts).alias("texts"))


def decoded_ok(segments: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, segment, ok: whether ``decoded`` gives texts."""
    return _ok(decoded(segments, answers))


def decoded_rows_ok(answered: DataFrame) -> DataFrame:
    """``decoded_ok`` of segments that have their answer (raw) in their row."""
    return _ok(decoded_rows(answered))


def _ok(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "segment", F.col("texts").isNotNull().alias("ok"))


def name_like(text: Column) -> Column:
    """No words, or seven in ten start with a capital letter."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    capitals = F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))
    return (F.size(words) == 0) | (F.size(capitals) * 10 >= F.size(words) * 7)


def unchanged(source: Column, output: Column) -> Column:
    """A long text that is no list of names came back as it was."""
    return (F.length(source) >= MIN_CHARS) & (fn.collapsed(source) == fn.collapsed(output)) & ~name_like(source)


def translated(units: DataFrame, model: Model) -> DataFrame:
    """``units`` with output, calls and failed: one call, and a strict one where the first gave nothing or an echo.

    The retry's answer counts where there is one, else the first. Both passes are projections of one scan.
    """
    first = units.withColumn("_first", model(F.col("text"), F.lit(False)))
    again = F.col("_first").isNull() | unchanged(F.col("text"), F.col("_first"))
    second = first.withColumn("_again", again).withColumn("_second", F.when(F.col("_again"), model(F.col("text"), F.lit(True))))
    output = F.coalesce("_second", "_first")
    failed = output.isNull() | unchanged(F.col("text"), output)
    return second.select(*units.columns, output.alias("output"), F.when(F.col("_again"), 2).otherwise(1).alias("calls"), failed.alias("failed"))


def failed_blocks(outputs: DataFrame) -> DataFrame:
    """doc_id, block_idx of blocks with a failed unit."""
    return outputs.where("failed").select("doc_id", "block_idx").distinct()


def prompts(rows: DataFrame, system: str) -> DataFrame:
    """``rows`` (context, terms, body) with prompt: parts that are there, a blank line apart."""
    part = lambda title, column: F.when(F.length(column) > 0, F.concat(F.lit(title), F.col(column)))
    return rows.withColumn("prompt", F.concat_ws("\n\n", F.lit(system), part("Terms:\n", "terms"), part("Before:\n", "context"), "body"))


def report(missed: DataFrame, outputs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, kind, detail, source, expected: missed terms and failed units (80 characters of each)."""
    first = missed.join(outputs.select("doc_id", "unit_idx", "text"), ["doc_id", "unit_idx"]).join(terms, "row")
    excerpt = F.substring(fn.without_tags(F.col("text")), 1, 80).alias("detail")
    return first.select("doc_id", F.lit("term").alias("kind"), excerpt, "source", F.col("target").alias("expected")).unionByName(outputs.where("failed").select("doc_id", F.lit("failed").alias("kind"), excerpt, F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("expected")))


def same_structure(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, same: whether both tables of blocks have blocks of one kind and as many cells at every place."""
    shape = lambda df, name: df.select("doc_id", "block_idx", F.struct("kind", F.size(F.split("text", r" \| ")).alias("cells")).alias(name))
    cells = lambda df: df.withColumn("text", F.when(F.col("kind") == "table", F.col("text")).otherwise(""))
    both = shape(cells(left), "a").join(shape(cells(right), "b"), ["doc_id", "block_idx"], "full")
    return both.groupBy("doc_id").agg(F.every(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def tagged(pieces: DataFrame) -> DataFrame:
    """key, text of pieces (key, pos, text, link, bold, italic, underline): neighbours of one format in nested tags, links outermost."""
    order = Window.partitionBy("key").orderBy("pos")
    link, form = F.coalesce("link", F.lit(0)), F.struct("bold", "italic", "underline")
    marked = pieces.withColumn("_link", link).withColumn("_form", form)
    starts = marked.withColumn("_new_link", ~F.col("_link").eqNullSafe(F.lag("_link").over(order))).withColumn("_new", F.col("_new_link") | ~F.col("_form").eqNullSafe(F.lag("_form").over(order)))
    numbered = starts.withColumn("_outer", F.sum(F.col("_new_link").cast("int")).over(order)).withColumn("_inner", F.sum(F.col("_new").cast("int")).over(order))
    runs = numbered.groupBy("key", "_outer", "_inner", "_link", "_form").agg(_in_order(F.col("pos"), F.col("text"), "").alias("t"))
    text = F.col("t")
    for flag, tag in (("underline", "u"), ("italic", "i"), ("bold", "b")):
        text = F.when(F.col(f"_form.{flag}"), F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)
    links = runs.withColumn("t", text).groupBy("key", "_outer", "_link").agg(_in_order(F.col("_inner"), F.col("t"), "").alias("t"))
    name = F.concat(F.lit("a"), F.col("_link"), F.lit(">"))
    whole = F.when(F.col("_link") > 0, F.concat(F.lit("<"), name, F.col("t"), F.lit("</"), name)).otherwise(F.col("t"))
    return links.withColumn("t", whole).groupBy("key").agg(_in_order(F.col("_outer"), F.col("t"), "").alias("text"))


def available(models: DataFrame, installed: DataFrame) -> DataFrame:
    """``models`` (tag) with installed: whether ``installed`` has the tag, in any case."""
    present = installed.select(F.lower("tag").alias("_tag")).distinct().withColumn("installed", F.lit(True))
    return models.join(present, F.lower("tag") == F.col("_tag"), "left").select(*models.columns, F.coalesce("installed", F.lit(False)).alias("installed"))


#: Passes over what still reads as the source language.
REVIEW_ROUNDS = 2


def scores(outputs: DataFrame, counts: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """``outputs`` (doc_id, unit_idx, text, output) with score: 2 untranslated, 1 with sentences of the source language, 0 clean.

    Untranslated: no output, the text itself, or an output that reads as the source language. ``counts`` are trigram
    counts by language. With one language for both only missing and unchanged outputs count.
    """
    same = F.col("output").isNull() | F.coalesce(unchanged(F.col("text"), F.col("output")), F.lit(False))
    if source_lang == target_lang:
        return outputs.withColumn("score", F.when(same, 2).otherwise(0))
    sent = language.sent_counts(counts)
    if sent is not None:
        # an output and its sentences are judged in their row, which neither moves nor meets another
        long = F.length("text") >= language.MIN_CHARS
        rows = outputs.withColumn("_same", same)
        asked = F.when(~F.col("_same"), F.concat(F.array(F.when(long, F.col("output")).otherwise("")), language.long_sentences(F.col("output"))))
        judged = language.judged_lists(rows, asked, sent)
        reads = lambda lang: F.coalesce(lang == source_lang, F.lit(False))
        echo = long & (language.same_words(F.col("text"), F.col("output")) | reads(F.get("langs", F.lit(0))))
        mixed = F.exists(F.slice("langs", F.lit(2), F.greatest(F.size("langs"), F.lit(0))), reads)
        return judged.select(*outputs.columns, F.when(F.col("_same"), 2).when(F.coalesce(echo, F.lit(False)), 2).when(mixed, 1).otherwise(0).alias("score"))
    keyed = outputs.where("output is not null").select(F.struct("doc_id", "unit_idx").alias("doc_id"), "text", "output")
    pairs = keyed.select("doc_id", F.col("text").alias("source"), "output")
    echo = language.looks_untranslated(pairs, counts, source_lang, target_lang)
    mixed = language.has_source_sentence(keyed.select("doc_id", F.col("output").alias("text")), counts, source_lang)
    judged = echo.join(mixed, "doc_id").select("doc_id.*", F.when(F.col("untranslated"), 2).when(F.col("has_sentence"), 1).otherwise(0).alias("_score"))
    joined = outputs.join(judged, ["doc_id", "unit_idx"], "left")
    return joined.select(*outputs.columns, F.when(same, 2).otherwise(F.coalesce("_score", F.lit(0))).alias("score"))


def reviewed(outputs: DataFrame, model: Model, counts: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """``outputs`` (doc_id, unit_idx, block_idx, text, output, calls, failed) after ``REVIEW_ROUNDS`` strict calls for each unit that isn't clean.

    An answer replaces the output only if its score is lower. Each round starts from a checkpoint. Returns them with score; failed: still untranslated
    and without any output that differs from the text.
    """
    counts, outputs = settled(counts), settled(outputs)
    current = settled(scores(outputs, counts, source_lang, target_lang))
    for _ in range(REVIEW_ROUNDS):
        todo = F.col("score") > 0
        asked = settled(current.where(todo).select("doc_id", "unit_idx", "text", model(F.col("text"), F.lit(True)).alias("output")))
        again = scores(asked, counts, source_lang, target_lang).select("doc_id", "unit_idx", F.col("output").alias("_new"), F.col("score").alias("_new_score"))
        joined = current.join(again, ["doc_id", "unit_idx"], "left")
        better = F.coalesce(F.col("_new").isNotNull() & (F.col("_new_score") < F.col("score")), F.lit(False))
        current = settled(joined.select(
            *[x for x in outputs.columns if x not in ("output", "calls")],
            F.when(better, F.col("_new")).otherwise(F.col("output")).alias("output"),
            (F.col("calls") + todo.cast("int")).alias("calls"),
            F.when(better, F.col("_new_score")).otherwise(F.col("score")).alias("score"),
        ))
    kept = F.col("output").isNotNull() & ~unchanged(F.col("text"), F.col("output"))
    return current.withColumn("failed", ~kept).select(*outputs.columns, "score")


def mixed_blocks(review: DataFrame) -> DataFrame:
    """doc_id, block_idx of reviewed blocks with a translated unit that isn't clean, unless one of their units failed."""
    blocks = review.groupBy("doc_id", "block_idx").agg(F.bool_or("failed").alias("failed"), F.bool_or(F.col("score") > 0).alias("flagged"))
    return blocks.where("flagged and not failed").select("doc_id", "block_idx")
