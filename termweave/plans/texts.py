"""Queries of terms in compound words, of inline Markdown, of files and of the event sink; and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import inline
from termweave.functions import text as fn
from termweave.operators import benchmark, glossary, job, results, units
from termweave.operators._settled import new_folder
from termweave.plans import catalogue as c
from termweave.plans import translation
from termweave.sources import files, markdown
from termweave.streaming import usage

# Terms that words of the documents end with; longer ones claim a word before shorter ones.
ENDINGS = [(2, "and"), (3, "tion"), (4, "ation"), (5, "ing"), (6, "the"), (7, "able"), (8, "ble"), (9, "ción"), (10, "ung"), (11, "tionand")]


def glossary_compound(s: SparkSession, d: str) -> DataFrame:
    """Terms as words and at the end of longer words."""
    return glossary.match_terms(c._units(s, d), s.createDataFrame(ENDINGS, "row int, source string"), compound=True)


def term_misses_compound(s: SparkSession, d: str) -> DataFrame:
    """Terms whose target the answers lack, where longer words may end with it."""
    return glossary.missed_terms(c._matches(s, d), c._answers(c._units(s, d)), c._sheet(s, c.TERMS), compound=True)


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents as Markdown: of each twenty words four are strong, four emphasised, four code, four a link."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    lines = c.line_blocks(c._docs(s, d)).select("doc_id", "block_idx", words.alias("words")).where(F.size("words") > 0)

    def group(start):
        text, kind = F.array_join(F.slice("words", start + 1, 4), " "), F.pmod(start / 4, F.lit(5))
        link = F.concat(F.lit("["), text, F.lit("](https://a.example/"), start.cast("string"), F.lit(' "title")'))
        around = lambda mark: F.concat(F.lit(mark), text, F.lit(mark))
        return F.when(kind == 0, around("**")).when(kind == 1, around("_")).when(kind == 2, around("`")).when(kind == 3, link).otherwise(text)

    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(4))
    return lines.select("doc_id", "block_idx", F.array_join(F.transform(starts, group), " ").alias("md"))


def inline_runs(s: SparkSession, d: str) -> DataFrame:
    return _marked(s, d).select("doc_id", "block_idx", F.posexplode(inline.runs(F.col("md"))).alias("at", "run")).select("doc_id", "block_idx", "at", "run.*")


def usage_append(s: SparkSession, d: str) -> DataFrame:
    """The events in four parts by time, the second one twice, appended by one start of the stream each, and read back."""
    events = c._events(s, d)
    folder = new_folder(s, "events")
    seconds = F.unix_timestamp(F.to_timestamp("ts"))
    cuts = events.select(seconds.alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01)
    part = sum((seconds > F.lit(t)).cast("int") for t in cuts)
    logged = events.withColumnRenamed("pos", "event_id").withColumn("part", part)
    for n in (0, 1, 1, 2, 3):
        logged.where(F.col("part") == n).drop("part").write.mode("append").json(f"{folder}/in")
        usage.append_events(s, f"{folder}/in", f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return usage.read_appended(s, f"{folder}/log").select(F.col("event_id").alias("pos"), "ts", "event", "user", "status", "duration_s", "day")


def read_files(s: SparkSession, d: str) -> DataFrame:
    """A text file for each page, and one of a type that isn't read, read back as paragraphs and errors."""
    # a folder for each page would cost more than its files, so all lie in one: a task's nth file has its nth row, which its
    # name tells. All tasks write, and put their own files in place: none waits for the driver to move them
    pages = c._read(s, d, "pages").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "page_id").sortWithinPartitions("page_id", "url", "html")
    folder = new_folder(s, "pages")
    placed = lambda column: pages.select(column).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 1)
    placed("html").text(folder)
    placed("url").json(folder)
    part = lambda n: F.regexp_extract("path", r"/part-([0-9]+)-[^/]*-c([0-9]+)\.[^/]*$", n).cast("long")
    read = files.read_files(s, folder).withColumn("file", F.shiftleft(part(1), 33) + part(2))
    named = pages.select("page_id", F.monotonically_increasing_id().alias("file"))
    return read.join(named, "file").select("page_id", "block_idx", "kind", "text", "error")


def _tables(s: SparkSession, d: str) -> DataFrame:
    """Blocks of document lines: every second line is a table of three words a row, every third of the others isn't translated."""
    three = lambda words: F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(3)), lambda at: F.slice(words, at + 1, 3))
    table = F.col("block_idx") % 2 == 1
    rows = F.when(table, fn.let(F.split("line", " "), three)).otherwise(F.array().cast("array<array<string>>"))
    lines = c.line_blocks(c._docs(s, d)).withColumnRenamed("text", "line")
    return lines.select("doc_id", "block_idx", F.when(table, "table").otherwise("paragraph").alias("kind"), F.when(table, "").otherwise(F.col("line")).alias("text"), rows.alias("rows"), (table | (F.col("block_idx") % 3 != 0)).alias("translate"))


def plan_tables(s: SparkSession, d: str) -> DataFrame:
    return units.planned(_tables(s, d), 100_000).select("doc_id", "unit_idx", "block_idx", "cell", "piece", "text")


def assemble_tables(s: SparkSession, d: str) -> DataFrame:
    """Blocks with the outputs of their units, of which every seventh failed."""
    planned = units.planned(_tables(s, d), 100_000)
    outputs = planned.withColumn("failed", F.col("unit_idx") % 7 == 3).withColumn("output", F.concat(F.lit("> "), "text"))
    shown = job.translated_blocks(_tables(s, d), outputs)
    return shown.select("doc_id", "block_idx", "text", F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n").alias("table"))


def _items(s: SparkSession, d: str) -> DataFrame:
    """Blocks of document lines: items of lists three deep, ordered or not by their length, with a paragraph here and there."""
    item = F.char_length("text") % 7 != 0
    return c.line_blocks(c._docs(s, d)).select("doc_id", "block_idx", F.when(item, "list_item").otherwise("paragraph").alias("kind"), F.when(item, F.char_length("text") % 3).otherwise(0).alias("depth"), (item & (F.char_length("text") % 5 != 0)).alias("ordered"))


def _report(s: SparkSession, d: str) -> DataFrame:
    outputs = translation._outputs(s, d)
    return outputs.where("failed").select("doc_id", F.lit("failed").alias("kind"), F.col("unit_idx").alias("place"), F.substring(fn.without_tags(F.col("text")), 1, 80).alias("detail"))


def models_to_run(s: SparkSession, d: str) -> DataFrame:
    nations = c._read(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("tag"))
    rich = c._read(s, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("key"))
    return benchmark.to_run(nations, nations.join(rich, "key").select(F.lower("tag").alias("tag")))


QUERIES = {
    "list_numbers": lambda s, d: markdown.numbered(_items(s, d)).select("doc_id", "block_idx", "depth", "number"),
    "report_notices": lambda s, d: results.notices(_report(s, d)),
    "upload_language": lambda s, d: results.inspected(c.line_blocks(c._docs(s, d)), translation._counts(s, d)),
    "untranslated_texts": lambda s, d: benchmark.untranslated(_tables(s, d), translation._counts(s, d), "en"),
    "models_to_run": models_to_run,
} | {"usage_append": usage_append, "read_files": read_files, "plan_tables": plan_tables, "assemble_tables": assemble_tables, "inline_runs": inline_runs, "glossary_compound": glossary_compound, "term_misses_compound": term_misses_compound}

_ENDED = ", ".join(f"({row}, '{term}')" for row, term in ENDINGS)
_CELLS = c._BLOCKS + r""", b AS (SELECT doc_id, block_idx, block_idx % 2 = 1 AS is_table, text, block_idx % 2 = 1 OR block_idx % 3 <> 0 AS translate FROM blocks),
cells AS (SELECT doc_id, block_idx, translate, is_table, unnest(CASE WHEN is_table THEN string_split(text, ' ') ELSE [text] END) AS text, unnest(range(len(CASE WHEN is_table THEN string_split(text, ' ') ELSE [text] END))) AS cell FROM b),
planned AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, cell) - 1 AS unit_idx FROM cells WHERE translate AND regexp_matches(text, '\p{L}')) """
ORACLES = {
    # each item counts the ordered ones of its depth since the last block that ended such a list
    "list_numbers": c._BLOCKS + """, b AS (SELECT doc_id, block_idx, length(text) % 7 <> 0 AS item, CASE WHEN length(text) % 7 <> 0 THEN length(text) % 3 ELSE 0 END AS depth, length(text) % 7 <> 0 AND length(text) % 5 <> 0 AS ordered FROM blocks),
ends AS (SELECT *, """ + ", ".join(f"max(CASE WHEN NOT item OR depth < {n} OR (depth = {n} AND NOT ordered) THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS e{n}" for n in range(3)) + """ FROM b),
mine AS (SELECT *, coalesce(CASE depth WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END, -1) AS since FROM ends)
SELECT doc_id, block_idx::INTEGER AS block_idx, depth::INTEGER AS depth, CASE WHEN item AND ordered THEN (SELECT count(*) FROM mine o WHERE o.doc_id = m.doc_id AND o.item AND o.ordered AND o.depth = m.depth AND o.block_idx > m.since AND o.block_idx <= m.block_idx)::INTEGER END AS number FROM mine m""",
    "report_notices": c._UNITS + translation._OUT + """, r AS (SELECT doc_id, substr(text, 1, 80) AS detail, row_number() OVER (PARTITION BY doc_id ORDER BY unit_idx) AS at FROM judged WHERE failed)
 SELECT doc_id, 'failed' AS kind, count(*) AS n, string_agg('- ' || detail, chr(10) ORDER BY "at") FILTER ("at" <= 10) AS listed, greatest(count(*) - 10, 0) AS more FROM r GROUP BY doc_id""".replace(" AS at ", ' AS "at" '),
    "upload_language": translation._BAYES.format(asked="SELECT doc_id, substr(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), ' '), 1, 2000) AS t FROM documents") + "SELECT d.doc_id, f.lang FROM documents d LEFT JOIN found f USING (doc_id)",
    "untranslated_texts": _CELLS + ", counts" + translation._BAYES.format(asked="SELECT doc_id || ':' || block_idx || ':' || cell AS doc_id, substr(text, 1, 2000) AS t FROM cells WHERE translate AND length(text) >= 40").split("WITH counts", 1)[1]
    + ", n AS (SELECT split_part(doc_id, ':', 1)::BIGINT AS doc_id, count(*) AS n FROM found WHERE lang = 'en' GROUP BY 1) SELECT d.doc_id, coalesce(n, 0) AS untranslated FROM documents d LEFT JOIN n USING (doc_id)",
    "models_to_run": "SELECT n_nationkey AS key, n_name AS tag FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)",
    "usage_append": c._EV + 'SELECT pos, ts, event, "user", status, duration_s, ts[:10] AS day FROM ev',
    "read_files": r"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, unnest(range(len(parts)))::INTEGER AS block_idx, 'paragraph' AS kind, unnest(parts) AS text, NULL::VARCHAR AS error FROM p
UNION ALL SELECT page_id, NULL, NULL, NULL, 'the file has no text' FROM p WHERE len(parts) = 0 UNION ALL SELECT page_id, NULL, NULL, NULL, 'file type ''.json'' is not supported' FROM p""",
    "plan_tables": _CELLS + "SELECT doc_id, unit_idx::INTEGER AS unit_idx, block_idx::INTEGER AS block_idx, cell::INTEGER AS cell, 0 AS piece, text FROM planned",
    "assemble_tables": _CELLS + """, said AS (SELECT c.*, CASE WHEN unit_idx IS NOT NULL AND unit_idx % 7 <> 3 THEN '> ' || c.text ELSE c.text END AS shown FROM cells c LEFT JOIN planned p ON p.doc_id = c.doc_id AND p.block_idx = c.block_idx AND p.cell = c.cell)
SELECT doc_id, block_idx::INTEGER AS block_idx, CASE WHEN is_table THEN '' ELSE min(shown) END AS text,
 CASE WHEN is_table THEN string_agg(CASE WHEN cell = 0 THEN '' WHEN cell % 3 = 0 THEN chr(10) ELSE ' | ' END || shown, '' ORDER BY cell) ELSE '' END AS "table" FROM said GROUP BY doc_id, block_idx, is_table""",
    # what each group of words shows as; plain groups and the spaces between groups join
    "inline_runs": c._BLOCKS + r""", w AS (SELECT doc_id, block_idx, regexp_extract_all(text, '\p{L}+') AS words FROM blocks WHERE regexp_matches(text, '\p{L}')),
g AS (SELECT doc_id, block_idx, unnest(range(0, len(words), 4)) AS start, words FROM w),
p AS (SELECT doc_id, block_idx, 2 * start AS pos, array_to_string(words[start + 1 : start + 4], ' ') AS text, (start // 4) % 5 AS kind, start FROM g
 UNION ALL SELECT doc_id, block_idx, 2 * start + 1, ' ', 4, start FROM g WHERE start + 4 < len(words)),
f AS (SELECT *, coalesce(lag(kind) OVER o = 4 AND kind = 4, false) AS more FROM p WINDOW o AS (PARTITION BY doc_id, block_idx ORDER BY pos)),
n AS (SELECT *, sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, block_idx ORDER BY pos) - 1 AS place FROM f)
SELECT doc_id, block_idx::INTEGER AS block_idx, place::INTEGER AS at, string_agg(text, '' ORDER BY pos) AS text, kind = 0 AS bold, kind = 1 AS italic, kind = 2 AS code,
 CASE WHEN kind = 3 THEN 'https://a.example/' || min(start) ELSE '' END AS href FROM n GROUP BY doc_id, block_idx, place, kind""",
    # all finds of one word end where it ends, so of each word the longest term stays
    "glossary_compound": c._UNITS + f""", terms(row, term) AS (VALUES {_ENDED}), forms AS (SELECT row, term, term || {c._FORMS} AS form FROM terms),
words AS (SELECT doc_id, unit_idx, unnest(regexp_extract_all({c._FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM units),
best AS (SELECT word, arg_max(row, length(term) * 1000 - row) AS row FROM (SELECT DISTINCT word FROM words) JOIN forms ON ends_with(word, form) GROUP BY word)
SELECT doc_id, unit_idx::INTEGER AS unit_idx, row::INTEGER AS row, count(*) AS n FROM words JOIN best USING (word) GROUP BY ALL""",
    "term_misses_compound": c._MISSES + r""", more AS (SELECT m.doc_id, m.unit_idx, m.row, m.n, len(list_filter(regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, target || '(e|en|er|es|n|s)?$'))) AS found
 FROM matches m JOIN answers a USING (doc_id, unit_idx) JOIN terms USING (row)) SELECT doc_id, unit_idx::INTEGER AS unit_idx, row::INTEGER AS row FROM more WHERE found < n""",
    # no two phrases overlap here: a phrase claims its words, and other words stand for themselves
    "term_match_longest": c._UNITS + f""", terms(row, source, target) AS (VALUES {c._VALUES}), forms AS (SELECT DISTINCT row, source || {c._FORMS} AS form FROM terms),
phrases(row, first) AS (VALUES {", ".join(f"({row}, '{source.split()[0]}')" for row, source, _ in translation.PHRASES)}),
cut AS (SELECT doc_id, unit_idx, regexp_extract_all({c._FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS tokens FROM units),
placed AS (SELECT doc_id, unit_idx, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM cut),
ahead AS (SELECT *, lead(token) OVER o AS gap, lead(token, 2) OVER o AS following FROM placed WINDOW o AS (PARTITION BY doc_id, unit_idx ORDER BY pos)),
marked AS (SELECT a.*, p.row AS phrase FROM ahead a LEFT JOIN phrases p ON a.token = p.first AND gap = ' ' AND following IN (SELECT 'the' || {c._FORMS})),
open AS (SELECT *, coalesce(phrase, lag(phrase, 2) OVER o) IS NULL AS free FROM marked WINDOW o AS (PARTITION BY doc_id, unit_idx ORDER BY pos)),
found AS (SELECT doc_id, unit_idx, phrase AS row FROM open WHERE phrase IS NOT NULL UNION ALL SELECT doc_id, unit_idx, row FROM open JOIN forms ON form = token WHERE free)
SELECT doc_id, unit_idx::INTEGER AS unit_idx, row::INTEGER AS row, count(*) AS n FROM found GROUP BY ALL""",
}
