"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The queries' key for surrogates; keep your own one secret.
SURROGATE_KEY = "key of the registered queries"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_bytes

    return dedup_bytes(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken_words, training_order

    return taken_words(*training_order(_table(spark, sf_dir, "documents")))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: what op4_curriculum_mix counts, with positions."""
    from .mixing import training_order

    return training_order(_table(spark, sf_dir, "documents"))[1].select("doc_id", "source", "position")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality, trusted_documents

    judged = quality(_table(spark, sf_dir, "documents"), trusted_documents(_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    return replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_token_files, write_token_files
    from .tokens import default_vocabulary

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), default_vocabulary()))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import default_vocabulary

    return pack_documents(_table(spark, sf_dir, "documents"), default_vocabulary())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact_index import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP1 = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored) WHERE place <= 5
"""

_OP2 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM docs WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
), removed AS (
  SELECT DISTINCT doc_id, i + o AS place FROM later, range(20) r(o)
), flat AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS place FROM docs
), kept AS (
  SELECT f.doc_id, string_agg(word, ' ' ORDER BY f.place) AS kept_text, count(*) AS n
  FROM flat f LEFT JOIN removed r ON r.doc_id = f.doc_id AND r.place = f.place WHERE r.place IS NULL GROUP BY f.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_OP4 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
  FROM rows GROUP BY source
), caps AS (
  SELECT *, [5, 2, 1][n % 3 + 1]::BIGINT AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS everything FROM sizes
), filled AS (
  SELECT *, everything * 150 - 100 * coalesce(sum(cap) OVER before, 0) AS free,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM caps
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (SELECT min(place) FROM filled f WHERE f.free * f.weight < 100 * f.cap * f.open_weight) AS first_open FROM filled
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN o.place IS NULL THEN l.cap::DOUBLE
              ELSE least(l.cap::DOUBLE, (l.weight * o.free)::DOUBLE / (o.open_weight * 100)::DOUBLE) END AS target
  FROM levels l LEFT JOIN filled o ON o.place = l.first_open
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.ord, r.doc_id NULLS FIRST, r.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.size AS start,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN 2 * start + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""

# each copy's share of its source's demand, inverted along the source's schedule
_OP4_ORDER = (
    _OP4.split("SELECT doc_id, size, source_size, target,\n")[0].replace("SELECT l.source, l.source_size,", "SELECT l.source, l.n, l.source_size,").replace("SELECT r.doc_id, r.size,", "SELECT r.doc_id, r.source, t.n, r.size,")
    + r"""
, copies AS (
  SELECT *, [-0.5, 0.0, 0.5][n % 3 + 1]::DOUBLE AS slope, CASE WHEN target > 0 THEN source_size::DOUBLE / target ELSE 0 END AS pass_length,
         least(1.0::DOUBLE, CASE WHEN target > 0 THEN start::DOUBLE / target ELSE 0 END) AS first_share,
         unnest(range((whole + CASE WHEN 2 * start + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END)::BIGINT)) AS copy
  FROM placed
), shares AS (SELECT *, least(1.0::DOUBLE, first_share + copy * pass_length) AS share FROM copies)
SELECT doc_id, source, CASE WHEN slope = 0 THEN share ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (-(1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope))) END AS position
FROM shares
"""
)

_OP9 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) AS i FROM docs)
), sizes AS (
  SELECT d.doc_id, count(s.s)::BIGINT AS n FROM docs d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * both_have >= 75 * (p.n + q.n - both_have)
), reach AS (
  SELECT doc_id AS start, doc_id AS at FROM docs UNION SELECT r.start, l.y FROM reach r JOIN links l ON l.x = r.at
)
SELECT z.doc_id, z.n AS n_shingles, min(r.at) AS component_id FROM sizes z JOIN reach r ON r.start = z.doc_id GROUP BY 1, 2
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, E' \t\n\f\r\v'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AS dropped FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP12 = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (
  SELECT doc_id, term, n, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings CROSS JOIN totals GROUP BY term, n_docs
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM postings JOIN weights USING (term) CROSS JOIN totals
), scored AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored QUALIFY rank <= 50
"""

_OP13 = rf"""
WITH bits AS (
  SELECT i AS byte, list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS entry FROM range(256) t(i)
), crc_table AS (SELECT list(entry ORDER BY byte) AS t FROM bits
), docs AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), flat AS (SELECT doc_id, unnest(words) AS word FROM docs
), vocabulary AS (SELECT word FROM flat UNION SELECT word FROM items
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
    lambda c, byte: xor(c // 256, t[xor(c, byte) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM vocabulary CROSS JOIN crc_table
), raw AS (SELECT bucket, count(*) AS s FROM flat JOIN hashed USING (word) GROUP BY bucket
), target AS (SELECT bucket, count(*) AS t FROM items JOIN hashed USING (word) GROUP BY bucket
), sums AS (SELECT (SELECT count(*) FROM flat) AS s_all, (SELECT count(*) FROM items) AS t_all
), gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN raw ON raw.bucket = b LEFT JOIN target ON target.bucket = b CROSS JOIN sums
), weighed AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM flat JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN ((total - ((total % n) + n) % n) // n) ELSE 0 END AS weight,
         floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM docs d LEFT JOIN weighed w ON w.doc_id = d.doc_id
), placed AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ball_tree_top_k": op1_ball_tree_top_k,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op4_training_order": op4_training_order,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_token_files": op7_token_files,
    "op8_factorisation_machine": op8_factorisation_machine,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_line_dedup": op11_line_dedup,
    "op12_impact_search": op12_impact_search,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op1_ball_tree_top_k": _OP1, "op2_substring_dedup": _OP2, "op4_curriculum_mix": _OP4, "op4_training_order": _OP4_ORDER, "op9_ngram_jaccard": _OP9, "op11_line_dedup": _OP11, "op12_impact_search": _OP12, "op13_importance_resampling": _OP13}
