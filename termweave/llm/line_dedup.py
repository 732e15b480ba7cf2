"""Lines that many documents share, dropped from all of them.

Normalised lines are hashed in place, documents are counted for each hash, and lines whose hash passes the threshold are
dropped by their position. Only hashes and positions move; a text moves once, to meet the positions of its dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import removed, written

#: Hashes that are sent to all tasks, at most: those that hold more than this part of all lines of documents.
BROADCAST_HASHES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _digest(text: Column) -> Column:
    """128 bits of SHA-256: hashes that decide what is deleted must not be made to meet."""
    return F.substring(F.sha2(text, 256), 1, 32)


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of ``docs`` (doc_id, text; other columns are left out).

    Lines are cut at \\n. A key (``line_key``) of at least ``min_chars`` code points that stands in at least
    ``min_documents`` rows loses all its lines; lines that stay are joined by \\n. Each row is a document, also where a
    doc_id is null or repeats; a line that repeats within one row counts once. Null and empty texts are one empty line,
    which stays. A text of which no line stays is empty. An empty table gives no rows.

    Hashes are counted with map-side sums. The commonest of those over the threshold, ``BROADCAST_HASHES`` at most, are
    sent to all tasks, so no task gets all lines of one hash; the rest, each a small part of all, are joined by hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = _digest(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)).alias("row")
    key_hash = lambda key: F.when(F.char_length(key) >= min_chars, _digest(key)).otherwise("")
    keys = F.transform(F.split(text, "\n", -1), line_key)
    hashed = written(docs.select(row, F.transform(keys, key_hash).alias("hashes")), "line-hashes")

    each = hashed.select(F.explode(F.array_distinct("hashes")).alias("hash")).where("hash <> ''")
    shared = written(each.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents), "shared-lines")
    everywhere = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # fewer than BROADCAST_HASHES can each have more than this part of the sum
    common = F.col("n") > everywhere // BROADCAST_HASHES
    lines = hashed.select("row", F.posexplode("hashes").alias("at", "hash")).where("hash <> ''")
    dropped = lines.join(F.broadcast(shared.where(common).select("hash")), "hash", "left_semi")
    dropped = dropped.unionByName(lines.join(shared.where(~common).select("hash"), "hash", "left_semi"))
    dropped = written(dropped.groupBy("row").agg(F.collect_set("at").alias("dropped")), "dropped-lines")
    removed(hashed, shared)

    none = F.array().cast("array<int>")
    joined = docs.select("doc_id", text.alias("text"), row).join(dropped, "row", "left").withColumn("dropped", F.coalesce("dropped", none))

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n").alias("kept_text"))

    # the text is cut once: a lambda over it would cut it anew for each line
    out = joined.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), F.get(F.transform(F.array(F.split("text", "\n", -1)), kept), F.lit(0)).alias("kept"))
    return out.select("doc_id", "kept.n_lines", "n_dropped", "kept.kept_text")
