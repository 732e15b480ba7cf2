"""A document of any number of pages to measure translations with, their figures and a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators import language

# The terms, sentences, heading and table of the document.
TERMS = [
    ("Abklingbecken", "spent fuel pool"),
    ("Freigabe", "clearance"),
    ("Brennelement", "fuel assembly"),
    ("Strahlenschutz", "radiation protection"),
    ("Kontrollbereich", "controlled area"),
    ("Ortsdosisleistung", "ambient dose rate"),
    ("Rückbau", "decommissioning"),
    ("Dekontamination", "decontamination"),
    ("Genehmigungsbehörde", "licensing authority"),
    ("Aktivitätskonzentration", "activity concentration"),
]
SENTENCES = [
    "Die {a} wird nach Abschluss der {b} von der zuständigen Stelle geprüft und dokumentiert.",
    "Bei der {a} ist die {b} jederzeit nachvollziehbar zu belegen, sofern keine Ausnahme gilt.",
    "Für die {a} gelten die Vorgaben zur {b}, die im Betriebshandbuch näher beschrieben sind.",
    "Ohne vorherige {a} darf die {b} nicht begonnen werden; Abweichungen sind zu melden.",
    "Die Ergebnisse der {a} fließen in die Bewertung der {b} ein und werden jährlich überprüft.",
]
HEADING = "Abschnitt %d: Betrieb und Überwachung"
TABLE = [["Begriff", "Wert", "Bemerkung"], *[[term, "Wert", "Hinweis zur Prüfung"] for term, _ in TERMS[:3]]]
PARAGRAPHS, PER_PARAGRAPH, TABLE_EVERY = 6, 5, 3
# The table's head.
TABLE_HEAD = "| Model | Time | Segments | Calls | Glossary hits | Missed | Hit rate | Failed | Untranslated |\n|---|---|---|---|---|---|---|---|---|"


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _sentence(n: Column) -> Column:
    terms = [term for term, _ in TERMS]
    return F.replace(F.replace(_pick(SENTENCES, n), F.lit("{a}"), _pick(terms, n)), F.lit("{b}"), _pick(terms, n * 3 + 1))


def fixture(spark: SparkSession, pages: int = 10, doc_id: int = 1) -> DataFrame:
    """Blocks of a document of ``pages`` pages (``fixture_pages``)."""
    return fixture_pages(spark.range(1, pages + 1).select(F.lit(doc_id).alias("doc_id"), F.col("id").alias("page")))


def fixture_pages(pages: DataFrame) -> DataFrame:
    """Blocks of ``pages`` (doc_id, page from 1): on each a heading and six paragraphs, on every third one a table. Pages are independent rows."""
    page = pages.select("doc_id", F.col("page").cast("long").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(PARAGRAPHS + 1))).alias("at"))
    rows = page.where((F.col("at") <= PARAGRAPHS) | (F.col("page") % TABLE_EVERY == 0))
    first = ((F.col("page") - 1) * PARAGRAPHS + F.col("at") - 1) * PER_PARAGRAPH
    paragraph = F.array_join(F.transform(F.sequence(first, first + PER_PARAGRAPH - 1), _sentence), " ")
    heading, table = F.col("at") == 0, F.col("at") > PARAGRAPHS
    place = (F.col("page") - 1) * (PARAGRAPHS + 1) + F.floor((F.col("page") - 1) / TABLE_EVERY) + F.col("at")
    cells = F.array(*[F.array(*[F.lit(c) for c in row]) for row in TABLE])
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        place.cast("int").alias("block_idx"),
        F.when(heading, "heading").when(table, "table").otherwise("paragraph").alias("kind"),
        F.when(heading, F.format_string(HEADING, "page")).when(table, "").otherwise(paragraph).alias("text"),
        heading.cast("int").alias("level"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("ordered"),
        F.when(table, cells).otherwise(F.array().cast("array<array<string>>")).alias("rows"),
        F.lit("").alias("info"),
        F.lit(True).alias("translate"),
    )


def run_metrics(segmented: DataFrame, outputs: DataFrame, matches: DataFrame, missed: DataFrame) -> DataFrame:
    """doc_id, segments, calls, hits, misses, failed (blocks) for every document with units."""
    parts = [
        outputs.groupBy("doc_id").agg(F.sum("calls").alias("calls"), F.count_distinct(F.when(F.col("failed"), F.col("block_idx"))).alias("failed")),
        segmented.groupBy("doc_id").agg(F.count_distinct("segment").alias("segments")),
        matches.groupBy("doc_id").agg(F.count("*").alias("hits")),
        missed.groupBy("doc_id").agg(F.count("*").alias("misses")),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "doc_id", "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("segments", "calls", "hits", "misses", "failed")])


def hit_rate(hits: Column, misses: Column) -> Column:
    """The share of matched terms that an answer kept; one without any."""
    return F.when(hits > 0, (hits - misses) / hits).otherwise(1.0)


def results_table(results: DataFrame) -> DataFrame:
    """One row, md: results (pos, model, seconds, segments, calls, hits, misses, failed, untranslated; a row a model) as a table."""
    whole = lambda value: F.bround(value).cast("long").cast("string")
    rate = F.concat(whole(hit_rate(F.col("hits"), F.col("misses")) * 100), F.lit("%"))
    cells = ["model", F.concat(whole(F.col("seconds")), F.lit(" s")), "segments", "calls", "hits", "misses", rate, "failed", "untranslated"]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cells]), F.lit(" |"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda r: r["line"])
    return results.agg(F.array_join(F.concat(F.array(F.lit(TABLE_HEAD)), rows), "\n").alias("md"))


def result_files(results: DataFrame) -> DataFrame:
    """model, file: each model's Markdown file, colons in its name replaced."""
    return results.select("model", F.concat(F.replace("model", F.lit(":"), F.lit("_")), F.lit(".md")).alias("file"))


def untranslated(blocks: DataFrame, counts: DataFrame, source_lang: str) -> DataFrame:
    """doc_id, untranslated for every document of ``blocks``: its texts and cells of 40 characters or more in the source language.

    Each text is judged by its first 2,000 characters; blocks that aren't translated don't count, all cells do.
    """
    texts = F.concat(F.when(F.col("translate"), F.array("text")).otherwise(F.array().cast("array<string>")), F.flatten("rows"))
    each = blocks.select("doc_id", F.explode(texts).alias("text")).where(F.length("text") >= language.MIN_CHARS)
    found = language.detect_bayes(each, counts).where(F.col("lang") == source_lang).groupBy("doc_id").agg(F.count("*").alias("untranslated"))
    return blocks.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("untranslated", F.lit(0)).alias("untranslated"))


def to_run(models: DataFrame, installed: DataFrame) -> DataFrame:
    """Of the ``models`` (tag) that are asked for those that are ``installed`` (tag), in any case."""
    return models.join(installed.select(F.lower("tag").alias("_tag")).distinct(), F.lower("tag") == F.col("_tag"), "left_semi")
