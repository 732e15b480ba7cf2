"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import glossary, language, layout, units, usage
from termweave.sources.documents import line_blocks, usage_events

NOW = "2024-01-31T00:00:00+00:00"
TERMS = [(2, "the", "der"), (3, "and", "und"), (4, "that", "dass"), (5, "for", "für"), (6, "was", "war"), (7, "with", "mit")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(_read(spark, sf_dir, "events"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.units(line_blocks(_docs(spark, sf_dir)))


def _sheet(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "row int, source string, target string")


def _part_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of parts: the first word of a name, and a brand or nothing; it has repeats, conflicts and empty cells."""
    word = F.regexp_extract("p_name", r"^\s*([^ ]*)", 1)
    source = F.when(F.col("p_size") == 7, "").when(F.col("p_size") % 2 == 0, F.upper(word)).otherwise(F.concat(F.lit(" "), F.substring("p_name", 1, 12)))
    target = F.when(F.col("p_size") % 11 == 0, " ").otherwise(F.col("p_brand"))
    return _read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("int").alias("row"), source.alias("source"), target.alias("target"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.match_words(_units(spark, sf_dir), _sheet(spark, TERMS))


def _answers(df: DataFrame) -> DataFrame:
    """Deterministic answers: some echo, some are garbage, some miss a term, others replace terms."""
    text = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    for _, source, target in TERMS:
        text = F.when((F.lit(source) == "and") & (F.col("doc_id") % 13 == 0), text).otherwise(F.replace(text, F.lit(f" {source} "), F.lit(f" {target} ")))
    return df.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.col("text")).when(F.col("doc_id") % 11 == 0, F.lit("???")).otherwise(F.trim(text)))


def term_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([(r, t, s) for r, s, t in TERMS], "row int, source string, target string")
    return glossary.misses(_matches(spark, sf_dir), _answers(_units(spark, sf_dir)), targets)


def term_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, missed = _matches(spark, sf_dir).groupBy("row").agg(F.count("*").alias("hits")), term_misses(spark, sf_dir).groupBy("row").agg(F.count("*").alias("missed"))
    both = hits.join(missed, "row", "left").withColumn("missed", F.coalesce("missed", F.lit(0)))
    return both.select("row", "hits", "missed", F.round((F.col("hits") - F.col("missed")) / F.col("hits"), 6).alias("hit_rate"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout lines derived from document lines: 20 a page, a header and a footer each, sizes by position."""
    body = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    page, at = F.floor(F.col("n") / 20).cast("int"), F.col("n") % 20
    rows = body.select("doc_id", page.alias("page"), (page * 22 + at + 1).cast("int").alias("line_idx"), "text", F.when((F.col("n") % 9 == 0), 16.0).when(F.col("n") % 31 == 5, 20.0).otherwise(10.0).alias("size"), (F.lit(100.0) + at * 35).alias("top"))
    pages = rows.select("doc_id", "page").distinct()
    margin = lambda text, idx, top: pages.select("doc_id", "page", (F.col("page") * 22 + idx).cast("int").alias("line_idx"), text.alias("text"), F.lit(8.0).alias("size"), F.lit(top).alias("top"))
    every = rows.unionByName(margin(F.concat(F.lit("Document "), F.col("doc_id")), 0, 20.0)).unionByName(margin(F.concat(F.lit("Page "), F.col("page") + 1), 21, 960.0))
    return every.withColumn("bottom", F.col("top") + F.col("size")).withColumn("page_height", F.lit(1000.0))


_EV = """WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), ev AS (
SELECT event_id AS pos, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts,
 CASE event_type WHEN 'signup' THEN 'login_ok' WHEN 'click' THEN 'job_start' WHEN 'purchase' THEN 'job_end' WHEN 'view' THEN 'download' WHEN 'error' THEN 'login_failed' END AS event,
 'u' || user_id AS "user", CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END END AS status,
 CASE WHEN event_type = 'purchase' THEN value END AS duration_s FROM k) """
_TOTALS = """SELECT "user", count(*) FILTER (event = 'login_ok') AS logins, count(*) FILTER (event = 'job_start') AS jobs,
 round(coalesce(sum(duration_s) FILTER (event = 'job_end'), 0) / 60, 6) AS minutes, count(*) FILTER (event = 'download') AS downloads,
 count(*) FILTER (event = 'job_end' AND status = 'error') AS errors, max(ts) AS last_seen FROM ev WHERE event <> 'login_failed' {more} GROUP BY "user" """
_FIRST = """first AS (SELECT "user", row_number() OVER (ORDER BY min(pos)) AS place FROM ev WHERE event <> 'login_failed' GROUP BY "user") """
_BLOCKS = r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS block_idx FROM documents),
blocks AS (SELECT doc_id, block_idx, CASE WHEN block_idx = 0 THEN 'heading' WHEN contains(text, ' | ') THEN 'table' ELSE 'paragraph' END AS kind, text FROM lines) """
_UNITS = _BLOCKS + r""", cells AS (SELECT doc_id, block_idx, unnest(CASE WHEN kind = 'table' THEN string_split(text, ' | ') ELSE [text] END) AS text,
 unnest(range(len(CASE WHEN kind = 'table' THEN string_split(text, ' | ') ELSE [text] END))) AS cell FROM blocks),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, cell) - 1 AS unit_idx, block_idx, cell, text FROM cells WHERE regexp_matches(text, '\p{L}')) """
_VALUES = ", ".join(f"({r}, '{s}', '{t}')" for r, s, t in TERMS)
_FORMS = "unnest(['', 'e', 'en', 'er', 'es', 'n', 's'])"
_FOLD = "replace(lower({}), 'ß', 'ss')"
_MATCH = _UNITS + f""", terms(row, source, target) AS (VALUES {_VALUES}), forms AS (SELECT DISTINCT row, source || {_FORMS} AS form FROM terms),
words AS (SELECT doc_id, unit_idx, unnest(regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS form FROM units),
matches AS (SELECT doc_id, unit_idx, row, count(*) AS n FROM words JOIN forms USING (form) GROUP BY ALL) """
_REPLACED = "' ' || text || ' '"
for _row, _source, _target in TERMS:
    _next = f"replace({_REPLACED}, ' {_source} ', ' {_target} ')"
    _REPLACED = f"CASE WHEN doc_id % 13 = 0 THEN {_REPLACED} ELSE {_next} END" if _source == "and" else _next
_MISSES = _MATCH + f""", answers AS (SELECT doc_id, unit_idx, CASE WHEN doc_id % 7 = 0 THEN text WHEN doc_id % 11 = 0 THEN '???' ELSE trim({_REPLACED}) END AS text FROM units),
tforms AS (SELECT DISTINCT row, {_FOLD.format('target')} || {_FORMS} AS form FROM terms),
awords AS (SELECT doc_id, unit_idx, unnest(regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS form FROM answers),
found AS (SELECT doc_id, unit_idx, row, count(*) AS m FROM awords JOIN tforms USING (form) GROUP BY ALL),
misses AS (SELECT doc_id, unit_idx, row FROM matches LEFT JOIN found USING (doc_id, unit_idx, row) WHERE coalesce(m, 0) < n) """
_LINES = r"""WITH body AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
rows AS (SELECT doc_id, n // 20 AS page, (n // 20) * 22 + n % 20 + 1 AS line_idx, text, CASE WHEN n % 9 = 0 THEN 16.0 WHEN n % 31 = 5 THEN 20.0 ELSE 10.0 END::DOUBLE AS size, (100.0 + (n % 20) * 35)::DOUBLE AS top FROM body),
pages AS (SELECT DISTINCT doc_id, page FROM rows),
lines AS (SELECT *, top + size AS bottom, 1000.0 AS page_height FROM (SELECT * FROM rows UNION ALL SELECT doc_id, page, page * 22, 'Document ' || doc_id, 8.0, 20.0 FROM pages
 UNION ALL SELECT doc_id, page, page * 22 + 21, 'Page ' || (page + 1), 8.0, 960.0 FROM pages)) """
_LEVELS = """, sizes AS (SELECT doc_id, size, sum(length(text)) AS chars, min(line_idx) AS first FROM lines GROUP BY ALL),
bodies AS (SELECT doc_id, size AS body FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) = 1),
levels AS (SELECT doc_id, size, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC), 6) AS level FROM (SELECT DISTINCT doc_id, size FROM lines) JOIN bodies USING (doc_id) WHERE size >= 1.15 * body) """
_NUMBERED = """, l AS (SELECT lines.*, coalesce(level, 0) AS level, body FROM lines JOIN bodies USING (doc_id) LEFT JOIN levels USING (doc_id, size)),
 f AS (SELECT *, lag(level) OVER o IS NULL OR lag(level) OVER o <> level OR CASE WHEN level > 0 THEN page <> lag(page) OVER o OR top - lag(bottom) OVER o > 0.5 * size
  WHEN page <> lag(page) OVER o THEN regexp_matches(lag(text) OVER o, '[.!?:]$') ELSE top - lag(bottom) OVER o > 0.5 * body END AS new FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line_idx)),
 b AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS block FROM f) """
_CUT = "unnest(list_transform(range(1, length(lower({0})) - 1), lambda i: substr(lower({0}), i, 3)))"
_GRAMS = f"""WITH counts AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, {_CUT.format("text")} AS gram FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
profiles AS (SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM counts QUALIFY rank <= 300),
g AS (SELECT doc_id, {_CUT.format("substr(text, 1, 2000)")} AS gram FROM documents),
hits AS (SELECT g.doc_id, p.lang, count(*) AS hits FROM g JOIN profiles p USING (gram) GROUP BY ALL),
best AS (SELECT doc_id, lang FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) = 1) """

_SHEET = r"""WITH sheet AS (SELECT p_partkey + 1 AS row, trim(CASE WHEN p_size = 7 THEN '' WHEN p_size % 2 = 0 THEN upper(regexp_extract(p_name, '^\s*([^ ]*)', 1)) ELSE ' ' || substr(p_name, 1, 12) END) AS source,
 trim(CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_brand END) AS target FROM part), filled AS (SELECT *, lower(source) AS k FROM sheet WHERE source <> '' AND target <> ''),
groups AS (SELECT k, count(DISTINCT target) AS targets, min(row) AS first FROM filled GROUP BY k),
issues AS (SELECT row, source, target, CASE WHEN targets > 1 THEN 'conflict' WHEN row > first THEN 'duplicate' END AS issue FROM filled JOIN groups USING (k)
 UNION ALL SELECT row, source, target, 'empty_cell' FROM sheet WHERE (source = '') <> (target = '')) """

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "usage_totals": lambda s, d: usage.totals(_events(s, d)),
    "usage_since": lambda s, d: usage.totals(usage.since(_events(s, d), NOW, 7)),
    "usage_daily_jobs": lambda s, d: usage.daily(_events(s, d), "jobs"),
    "usage_daily_minutes": lambda s, d: usage.daily(_events(s, d), "minutes"),
    "usage_first_seen_order": lambda s, d: usage.users_in_order(_events(s, d)),
    "usage_series_fold": lambda s, d: usage.series(_events(s, d), "jobs"),
    "usage_kpis": lambda s, d: usage.kpis(_events(s, d)),
    "doc_blocks": lambda s, d: line_blocks(_docs(s, d)),
    "doc_nonempty": lambda s, d: line_blocks(_docs(s, d)).groupBy("doc_id").agg(F.bool_or(F.trim("text") != "").alias("has_text")),
    "plan_units": lambda s, d: _units(s, d),
    "pack_segments": lambda s, d: units.segments(_units(s, d), 1500).groupBy("doc_id", "segment").agg(F.count("*").alias("n_units"), F.sum(F.length("text")).alias("chars")),
    "sentence_pieces": lambda s, d: units.sentence_pieces(_units(s, d), 300).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("chars")),
    "protect_roundtrip": lambda s, d: _docs(s, d).select("doc_id", F.size(fn.protected(F.col("text"))[1]).alias("n_spans"), (fn.restored(*fn.protected(F.col("text"))) == F.col("text")).alias("same")),
    "wire_last_per_id": lambda s, d: units.last_per_run(units.wire_lines(_read(s, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("lead\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: F.concat(F.lit("[["), F.floor(t["turn"] / 2).cast("string"), F.lit("]] "), t["text"])), "\n")).alias("raw")).withColumnRenamed("conv_id", "key"))).select("key", "id"),
    "glossary_entries": lambda s, d: glossary.checked(_part_sheet(s, d)).where("issue is null").select("row", "source", "target"),
    "glossary_issues": lambda s, d: glossary.checked(_part_sheet(s, d)).where("issue is not null").select("row", "issue"),
    "glossary_match": _matches,
    "term_misses": term_misses,
    "term_hit_rate": term_hit_rate,
    "lang_profiles": lambda s, d: language.profiles(_read(s, d, "documents")),
    "lang_detect": lambda s, d: language.detect(_docs(s, d), language.profiles(_read(s, d, "documents"))),
    # every trigram counts here; the two above go by each language's most frequent ones
    "lang_profiles_whole": lambda s, d: language.gram_counts(_read(s, d, "documents")),
    "lang_detect_whole": lambda s, d: language.detect_bayes(_docs(s, d), language.gram_counts(_read(s, d, "documents"))),
    "context_carry": lambda s, d: units.context_pairs(_read(s, d, "conversations")),
    "assemble_blocks": lambda s, d: units.assemble(line_blocks(_docs(s, d)), _answers(_units(s, d)).where("doc_id % 5 <> 0").select("doc_id", "block_idx", "cell", "text")),
    "markdown_render": lambda s, d: units.markdown(line_blocks(_docs(s, d))),
    "layout_chrome": lambda s, d: layout.without_chrome(_lines(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines")),
    "layout_body_size": lambda s, d: layout.body_sizes(_lines(s, d)),
    "layout_heading_levels": lambda s, d: layout.heading_levels(_lines(s, d)),
    "layout_paragraphs": lambda s, d: layout.paragraphs(_lines(s, d)),
    "layout_block_texts": lambda s, d: layout.block_texts(_lines(s, d)),
    "slugify": lambda s, d: _read(s, d, "part").select("p_partkey", fn.slug(F.col("p_name")).alias("slug")),
}

ORACLES: dict[str, str] = {
    "usage_totals": _EV + _TOTALS.format(more=""),
    "usage_since": _EV + _TOTALS.format(more="AND ts >= '2024-01-24T00:00:00+00:00'"),
    "usage_daily_jobs": _EV + """SELECT ts[:10] AS day, "user", count(*)::DOUBLE AS value FROM ev WHERE event = 'job_start' GROUP BY ALL""",
    "usage_daily_minutes": _EV + """SELECT ts[:10] AS day, "user", round(sum(duration_s / 60), 6) AS value FROM ev WHERE event = 'job_end' GROUP BY ALL HAVING round(sum(duration_s / 60), 6) <> 0""",
    "usage_first_seen_order": _EV + ", " + _FIRST + 'SELECT "user", place::INTEGER AS place FROM first',
    "usage_series_fold": _EV + ", " + _FIRST + """SELECT ts[:10] AS day, CASE WHEN place <= 7 OR (SELECT count(*) FROM first) <= 8 THEN "user" ELSE 'Andere' END AS series, count(*)::DOUBLE AS value FROM ev JOIN first USING ("user") WHERE event = 'job_start' GROUP BY ALL""",
    "usage_kpis": _EV + """SELECT count(DISTINCT "user") FILTER (event <> 'login_failed') AS users, count(*) FILTER (event = 'login_ok') AS logins, count(*) FILTER (event = 'job_start') AS jobs, round(coalesce(sum(duration_s), 0) / 60, 1) AS minutes,
 count(*) FILTER (event = 'download') AS downloads, count(*) FILTER (event = 'login_failed') AS failed_sign_ins FROM ev""",
    "doc_blocks": _BLOCKS + "SELECT doc_id, block_idx::INTEGER AS block_idx, kind, text FROM blocks",
    "doc_nonempty": _BLOCKS + "SELECT doc_id, bool_or(trim(text) <> '') AS has_text FROM blocks GROUP BY doc_id",
    "plan_units": _UNITS + "SELECT doc_id, unit_idx::INTEGER AS unit_idx, block_idx::INTEGER AS block_idx, cell::INTEGER AS cell, text FROM units",
    "pack_segments": _UNITS.replace("WITH lines", "WITH RECURSIVE lines", 1) + """, pack AS (SELECT doc_id, unit_idx, 0 AS segment, length(text) AS used FROM units WHERE unit_idx = 0
 UNION ALL SELECT u.doc_id, u.unit_idx, CASE WHEN used + length(u.text) <= 1500 THEN segment ELSE segment + 1 END, CASE WHEN used + length(u.text) <= 1500 THEN used + length(u.text) ELSE length(u.text) END
 FROM pack p JOIN units u ON u.doc_id = p.doc_id AND u.unit_idx = p.unit_idx + 1)
 SELECT doc_id, segment, count(*) AS n_units, sum(length(text))::BIGINT AS chars FROM pack JOIN units USING (doc_id, unit_idx) GROUP BY ALL""",
    "glossary_entries": _SHEET + "SELECT row::INTEGER AS row, source, target FROM issues WHERE issue IS NULL",
    "glossary_issues": _SHEET + "SELECT row::INTEGER AS row, issue FROM issues WHERE issue IS NOT NULL",
    "glossary_match": _MATCH + "SELECT doc_id, unit_idx::INTEGER AS unit_idx, row::INTEGER AS row, n FROM matches",
    "term_misses": _MISSES + "SELECT doc_id, unit_idx::INTEGER AS unit_idx, row::INTEGER AS row FROM misses",
    "term_hit_rate": _MISSES + ", h AS (SELECT row, count(*) AS hits FROM matches GROUP BY row), m AS (SELECT row, count(*) AS missed FROM misses GROUP BY row) SELECT row::INTEGER AS row, hits, coalesce(missed, 0) AS missed, round((hits - coalesce(missed, 0)) / hits, 6) AS hit_rate FROM h LEFT JOIN m USING (row)",
    "lang_profiles": _GRAMS + "SELECT lang, gram, n, rank::INTEGER AS rank FROM profiles",
    "lang_profiles_whole": _GRAMS + "SELECT lang, gram, n FROM counts",
    "lang_detect": _GRAMS + "SELECT d.doc_id, b.lang FROM documents d LEFT JOIN best b USING (doc_id)",
    "context_carry": "SELECT conv_id, turn, last_value(CASE WHEN length(text) > 0 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM conversations",
    "markdown_render": _BLOCKS + "SELECT doc_id, string_agg(CASE kind WHEN 'heading' THEN '# ' || text WHEN 'table' THEN '| ' || text || ' |' || chr(10) || '|' || repeat('---|', len(string_split(text, ' | '))) ELSE text END, chr(10) || chr(10) ORDER BY block_idx) AS md FROM blocks GROUP BY doc_id",
    "layout_chrome": _LINES + r""", marked AS (SELECT *, regexp_replace(text, '[0-9]+', '#', 'g') AS sign, top < 0.1 * page_height OR bottom > 0.9 * page_height AS zone FROM lines),
 n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY doc_id), signs AS (SELECT doc_id, sign FROM marked JOIN n USING (doc_id) WHERE zone GROUP BY doc_id, sign, pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages * 6 / 10)))
 SELECT doc_id, count(*) AS n_lines FROM marked m WHERE NOT (zone AND EXISTS (SELECT 1 FROM signs s WHERE s.doc_id = m.doc_id AND s.sign = m.sign)) GROUP BY doc_id""",
    "layout_body_size": _LINES + _LEVELS + "SELECT doc_id, body FROM bodies",
    "layout_heading_levels": _LINES + _LEVELS + "SELECT doc_id, size, level::INTEGER AS level FROM levels",
    "layout_paragraphs": _LINES + _LEVELS + _NUMBERED + "SELECT doc_id, block::BIGINT AS block, max(level)::INTEGER AS level, count(*) AS n_lines FROM b GROUP BY doc_id, block",
    "layout_block_texts": _LINES + _LEVELS + _NUMBERED + r""", j AS (SELECT *, lead(text) OVER o IS NULL AS final, coalesce(regexp_matches(text, '\p{L}-$') AND regexp_matches(lead(text) OVER o, '^\p{Ll}'), false) AS glued
 FROM b WINDOW o AS (PARTITION BY doc_id, block ORDER BY line_idx))
 SELECT doc_id, block::BIGINT AS block, max(level)::INTEGER AS level, string_agg(CASE WHEN final THEN text WHEN glued THEN left(text, length(text) - 1) ELSE text || ' ' END, '' ORDER BY line_idx) AS text FROM j GROUP BY doc_id, block""",
    "slugify": r"SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), '-') AS slug FROM part",
}
