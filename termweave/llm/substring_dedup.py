"""Substring dedup by relative Lempel-Ziv parsing against an index of all earlier text.

The reference is the corpus itself, cut into phrases by anchors (see ``_anchors``). Its index lies in blocks, the hash
partitions of the anchors; every phrase of every document looks its anchor up in the block that has it, and so each
document is matched against every indexed reference block without being sent to all of them. A phrase that stands
earlier yields a match (document, place, length, source). Phrases that match no earlier one as a whole, but share their
anchor with others, are a factor's ends: there each window is checked on its own. From its matches every document is
factored greedily: at the first place not yet covered, the source that reaches furthest is copied, up to its end.

Factors are exact to the window: a window of ``window`` words is covered if and only if its words also start earlier.
Hash keys have 96 bits or more (64 of the anchor, 32 of each window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._anchors import anchored_runs
from ._store import written
from ._words import chunks, gram_hashes, mix, to_signed, variant_of, word_hashes

#: Words of an anchor.
GRAM = 5
_NO_ID = -(1 << 63)


def phrases(docs: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """anchor, checks (32 bits of each window of the phrase), doc, variant, start (word of its first window), windows, ref.

    Within a few hundred documents at a time only the first of equal phrases is kept whole. The others, whose ``ref``
    then names that one, need no index: they have no checks, and anchors that differ, so that a phrase which very many
    documents repeat stays in no single block. ``docs`` has doc, variant and text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            words, counts = word_hashes(texts)
            grams = gram_hashes(words, gram)
            anchor, index, size, doc, start = anchored_runs(grams, gram, window, counts)
            if not len(anchor):
                continue
            hashes = gram_hashes(words, window, 0xC2B2AE3D27D4EB4F)
            variant = batch.column(1).to_numpy()[doc]
            doc = batch.column(0).to_numpy()[doc]
            with np.errstate(over="ignore"):  # first and last window overlap, so both hashes stand for the whole phrase
                same = mix(mix(hashes[index]) + hashes[index + size - 1] * np.uint64(31) + size.astype(np.uint64))
            order = np.lexsort((start, variant, doc, same))
            fresh = np.r_[True, same[order][1:] != same[order][:-1]]
            leader = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            lead = np.empty_like(order)
            lead[order] = leader
            repeat = (doc[lead] != doc) | (variant[lead] != variant) | (start[lead] != start)
            key = np.where(repeat, mix(same + mix(doc.view(np.uint64) + variant.astype(np.uint64)) + start.astype(np.uint64)), grams[anchor])
            kept = np.where(repeat, 0, size)
            ends = np.cumsum(kept)
            data = hashes.astype(np.uint32)[np.repeat(index - (ends - kept), kept) + np.arange(ends[-1])]
            offsets = np.r_[0, 4 * ends].astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            columns = [pa.array(to_signed(key)), binary, pa.array(doc), pa.array(variant), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(doc[lead], mask=~repeat), pa.array(variant[lead], mask=~repeat), pa.array(start[lead].astype(np.int32), mask=~repeat)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "checks", "doc", "variant", "start", "windows", "ref_doc", "ref_variant", "ref_start"])

    found = docs.mapInArrow(cut, "anchor bigint, checks binary, doc bigint, variant bigint, start int, windows int, ref_doc bigint, ref_variant bigint, ref_start int")
    return found.select("anchor", F.when(F.col("ref_doc").isNull(), F.col("checks")).alias("checks"), "doc", "variant", "start", "windows", F.when(F.col("ref_doc").isNotNull(), F.struct(F.col("ref_doc").alias("doc"), F.col("ref_variant").alias("variant"), F.col("ref_start").alias("start"))).alias("ref"))


def matches(docs: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """doc, variant, start, windows, ref_doc, ref_start: runs of windows that also start earlier, with an earlier place."""
    by_phrase = Window.partitionBy("anchor", "checks").orderBy("doc", "variant", "start")
    by_anchor = Window.partitionBy("anchor")
    found = (
        phrases(docs, window, gram)
        .withColumn("ref", F.coalesce("ref", F.first(F.struct("doc", "variant", "start")).over(by_phrase.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
        .withColumn("others", F.min("checks").over(by_anchor) != F.max("checks").over(by_anchor))
        .withColumn("repeats", F.col("ref") != F.struct("doc", "variant", "start"))
        .where("repeats or others")
    )
    only_ends = ~F.col("repeats")
    found = written(found.select("repeats", F.when(only_ends, F.col("anchor")).alias("anchor"), F.when(only_ends, F.col("checks")).alias("checks"), "windows", "doc", "variant", "start", F.when(F.col("repeats"), F.col("ref")).alias("ref")), "phrases")
    whole = found.where("repeats").select("doc", "variant", "start", "windows", F.col("ref.doc").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    ends = found.where("not repeats").select("anchor", "doc", "variant", "start", "checks", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i"))
    single = ends.select("anchor", F.substring("checks", F.col("i") * 4 + 1, F.lit(4)).alias("check"), "doc", "variant", (F.col("start") + F.col("i")).alias("start"))
    first = F.first(F.struct("doc", "variant", "start")).over(Window.partitionBy("anchor", "check").orderBy("doc", "variant", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_ends = single.withColumn("ref", first).where(F.col("ref") != F.struct("doc", "variant", "start")).select("doc", "variant", "start", F.lit(1).alias("windows"), F.col("ref.doc").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    return whole.unionByName(at_ends)


def greedy_factors(runs: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, words, ref_doc, ref_start) from runs (start, windows, ref_doc, ref_start), sorted by start."""
    alive: dict[tuple[int, int], list[int]] = {}
    spans: list[tuple[int, int, int, int]] = []
    for start, size, doc, ref in runs:
        source = (doc, ref - start)
        last = alive.get(source)
        if last and last[1] >= start:
            last[1] = max(last[1], start + size)
        else:
            if last:
                spans.append((last[0], last[1], *source))
            alive[source] = [start, start + size]
    spans += [(a, b, *source) for source, (a, b) in alive.items()]
    spans.sort()
    factors: list[tuple[int, int, int, int]] = []
    at, i, best = 0, 0, None
    while True:
        while i < len(spans) and spans[i][0] <= at:
            if best is None or spans[i][1] > best[1]:
                best = spans[i]
            i += 1
        if best and best[1] > at:
            factors.append((at, best[1] - at + window - 1, best[2], at + best[3]))
            at = best[1]
        elif i < len(spans):
            at = spans[i][0]
        else:
            return factors


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = GRAM) -> DataFrame:
    """Removes every word covered by ``window`` words in a row that also start earlier in the corpus.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and factors (start, words, ref_doc,
    ref_start; in words). Earlier: smaller doc_id, or the same and an earlier start; judged on the input. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged. A null or empty text has no words. A null doc_id sorts before all others. Rows
    that repeat a doc_id with the same text count as one document; with other texts they are documents of their own, in
    the order of a hash of the text. An empty table gives no rows. Other columns are not read.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), variant_of(F.col("text").cast("string")).alias("variant"), F.col("text").cast("string").alias("text"))
    found = matches(source, window, gram)
    runs = found.groupBy("doc", "variant").agg(F.sort_array(F.collect_list(F.struct("start", "windows", "ref_doc", "ref_start"))).alias("runs"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
        for batch, texts in chunks(batches):
            n_words, n_removed, kept, factors = [], [], [], []
            for text, own in zip(texts, batch.column(2), strict=True):
                words = text.split()
                n_words.append(len(words))
                cover = [(r["start"], r["windows"], r["ref_doc"], r["ref_start"]) for r in own.as_py() or ()]
                parsed = greedy_factors(cover, window) if cover else []
                rest, at = [], 0
                for start, size, _, _ in parsed:
                    rest += words[at:start]
                    at = max(at, start + size)
                rest += words[at:]
                n_removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
                factors.append([{"start": a, "words": b, "ref_doc": None if c == _NO_ID else c, "ref_start": d} for a, b, c, d in parsed])
            ids = pa.array([None if i == _NO_ID else i for i in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, kind)], ["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    return source.join(runs, ["doc", "variant"], "left").select("doc", "text", "runs").mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, factors array<struct<start:int,words:int,ref_doc:bigint,ref_start:int>>")
