"""Suffix dedup by merging Burrows-Wheeler transforms.

What can repeat is found first: every string of ``length`` bytes has an anchor, its gram of least hash, and a phrase is a
run of such strings with one anchor (see ``_anchors``). Phrases whose anchor no other phrase has hold nothing repeated.
Equal phrases are runs of repeats as they stand. What is left are phrases that share an anchor and differ: their texts
are gathered by anchor, and there the repeated strings are found by suffix order. Each bucket's phrases are cut into
shards; a shard's suffixes are sorted and give its transform; the transforms are merged by refining the interleave: one
pass orders suffixes by one more symbol, a stable sort by the symbols before them, from the interleave of the pass
before. Boundaries between suffixes that differ travel along, and suffixes alone between two leave, so after ``length``
passes what is left are the intervals with a common prefix of ``length`` or more: the repeated strings, with no suffix
compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._anchors import anchored_runs
from ._store import written
from ._words import _BYTE, chunks, gram_hashes, mix, to_signed, variant_of

#: Bytes of an anchor, bytes of a shard, and bytes of text whose transforms are merged at once.
GRAM, SHARD_BYTES, BUCKET_BYTES = 32, 1 << 14, 1 << 16
_NO_ID = -(1 << 63)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols or more, by prefix doubling; ties stay in text order."""
    rank = text.astype(np.int64)
    step, n = 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (max(n, 256) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        step *= 2
        if step >= depth or rank[order[-1]] == n - 1:
            return order


class Transform:
    """A shard's Burrows-Wheeler transform: in suffix order, the symbol before each suffix, the place of the suffix that
    starts with that symbol, and where each suffix starts."""

    def __init__(self, pieces: list[bytes], depth: int):
        # symbol 0 ends a piece; bytes are 1 .. 256, so that no repeat reaches over an end
        text = np.concatenate([np.r_[np.frombuffer(p, np.uint8).astype(np.uint16) + 1, np.uint16(0)] for p in pieces])
        self.order = suffix_order(text, depth)
        self.before = text[self.order - 1]
        place = np.empty(len(text), np.int64)
        place[self.order] = np.arange(len(text))
        self.previous = place[self.order - 1]


def repeated_intervals(transforms: list[Transform], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms: shard, suffix (start) and interval of all suffixes whose first ``length`` symbols repeat.

    The interleave of the shards' suffixes is refined pass by pass. A pass deals its places by the symbol before their
    suffix, keeping their order: what comes out are the suffixes one symbol longer, ordered by one symbol more, with the
    intervals of a common prefix that long. A suffix alone in its interval has no repeat, and no longer suffix that ends
    in it has one either: it leaves the interleave.
    """
    base = np.cumsum([0, *(len(t.order) for t in transforms)])
    before = np.concatenate([t.before for t in transforms])
    previous = np.concatenate([t.previous + b for t, b in zip(transforms, base, strict=False)])
    place = np.arange(base[-1])
    interval = np.zeros(base[-1], np.int64)
    for _ in range(length):
        symbol = before[place]
        dealt = np.argsort(symbol, kind="stable")
        symbol, past = symbol[dealt], interval[dealt]
        fresh = np.ones(len(dealt) + 1, bool)
        # an end of a piece differs from all others: nothing repeats over it
        fresh[1:-1] = (symbol[1:] != symbol[:-1]) | (past[1:] != past[:-1]) | (symbol[1:] == 0)
        stays = ~(fresh[:-1] & fresh[1:])
        place = previous[place[dealt[stays]]]
        interval = np.cumsum(fresh[:-1][stays])
        if not len(place):
            break
    shard = np.searchsorted(base, place, "right") - 1
    return shard, np.concatenate([t.order for t in transforms])[place], interval


def _phrases(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            counts = np.array([len(t) for t in texts], np.int64)
            symbols = _BYTE[np.frombuffer(b"".join(texts), np.uint8)]
            if len(symbols) < length:
                continue
            grams = gram_hashes(symbols, gram)
            anchor, index, size, doc, start = anchored_runs(grams, gram, length, counts)
            if not len(anchor):
                continue
            strings = gram_hashes(symbols, length, 0xC2B2AE3D27D4EB4F)
            with np.errstate(over="ignore"):  # the first and last string overlap, so both hashes stand for the whole phrase
                content = mix(mix(strings[index]) + strings[index + size - 1] * np.uint64(31) + size.astype(np.uint64))
            columns = [to_signed(grams[anchor]), to_signed(content), batch.column(0).to_numpy()[doc], batch.column(1).to_numpy()[doc], start.astype(np.int32), size.astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "doc", "variant", "start", "size"])

    return docs.mapInArrow(cut, "anchor bigint, content bigint, doc bigint, variant bigint, start int, size short")


def _merged(texts: DataFrame, length: int) -> DataFrame:
    """doc, variant, start, size: single strings of the phrases (anchor, doc, variant, start, size, piece) that also start earlier."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, used = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                # equal strings have equal anchors, so a bucket may end wherever the anchor changes
                if row[0] != key and used >= BUCKET_BYTES:
                    yield found(held)
                    held, used = [], 0
                key = row[0]
                held.append(row)
                used += len(row[5])
        if held:
            yield found(held)

    def found(held: list) -> pa.RecordBatch:
        shards, at = [[]], 0
        for i, row in enumerate(held):
            if at >= SHARD_BYTES:
                shards.append([])
                at = 0
            shards[-1].append(i)
            at += len(row[5])
        transforms = [Transform([held[i][5] for i in own], length) for own in shards]
        source, suffix, interval = repeated_intervals(transforms, length)
        base = np.cumsum([0, *(len(t.order) for t in transforms)])[:-1]
        ends = np.cumsum([len(r[5]) + 1 for r in held])
        place = base[source] + suffix
        piece = np.searchsorted(ends, place, "right")
        offset = place - (ends[piece] - np.array([len(r[5]) + 1 for r in held])[piece])
        size = np.array([r[4] for r in held])[piece]
        real = offset < size
        doc = np.array([r[1] for r in held], np.int64)[piece][real]
        variant = np.array([r[2] for r in held], np.int64)[piece][real]
        start = np.array([r[3] for r in held], np.int64)[piece][real] + offset[real]
        order = np.lexsort((start, variant, doc, interval[real]))
        doc, variant, start, interval = doc[order], variant[order], start[order], interval[real][order]
        later = np.zeros(len(doc), bool)
        later[1:] = interval[1:] == interval[:-1]
        # copies of one place (rows that repeat a doc_id) aren't earlier than themselves
        first = np.maximum.accumulate(np.where(later, 0, np.arange(len(doc))))
        later &= (doc != doc[first]) | (variant != variant[first]) | (start != start[first])
        return pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(variant[later]), pa.array(start[later].astype(np.int32)), pa.array(np.ones(int(later.sum()), np.int16))], ["doc", "variant", "start", "size"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc", "variant", "start")
    return dealt.select("anchor", "doc", "variant", "start", "size", "piece").mapInArrow(buckets, "doc bigint, variant bigint, start int, size short")


def dedup_bytes(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """Removes every UTF-8 byte covered by ``length`` bytes in a row that also start earlier in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left, in a row). Earlier:
    smaller doc_id, or the same and an earlier start; overlaps count; judged on the input; no match crosses documents.
    A null text is empty. A null doc_id sorts before all others. Rows that repeat a doc_id with the same text count as
    one document; with other texts they are documents of their own, in the order of a hash of the text. An empty table gives no rows. Other columns are not read.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), variant_of(F.col("text").cast("string")).alias("variant"), F.col("text").cast("string").alias("text"))
    by_content = Window.partitionBy("anchor", "content").orderBy("doc", "variant", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_anchor = Window.partitionBy("anchor")
    found = (
        _phrases(source, length, gram)
        .withColumn("first", F.first(F.struct("doc", "variant", "start")).over(by_content))
        .withColumn("others", F.min("content").over(by_anchor) != F.max("content").over(by_anchor))
        .withColumn("repeats", F.col("first") != F.struct("doc", "variant", "start"))
        .where("repeats or others")
    )
    found = written(found.select(F.when(~F.col("repeats"), F.col("anchor")).alias("anchor"), "doc", "variant", "start", "size", "repeats"), "byte-phrases")
    asked = found.where("not repeats").groupBy("doc", "variant").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("asked"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = [(a["anchor"], doc, variant, a["start"], a["size"], text[a["start"] : a["start"] + a["size"] + length - 1]) for doc, variant, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3), strict=True) for a in asked.as_py()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()), strict=True)], ["anchor", "doc", "variant", "start", "size", "piece"])

    pieces = source.join(asked, ["doc", "variant"]).select("doc", "variant", "text", "asked").mapInArrow(gathered, "anchor bigint, doc bigint, variant bigint, start int, size short, piece binary")
    single = _merged(pieces, length)
    spans = found.where("repeats").select("doc", "variant", "start", "size").unionByName(single)
    runs = spans.groupBy("doc", "variant").agg(F.collect_list(F.struct("start", "size")).alias("runs"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            removed, spans, kept = [], [], []
            for text, own in zip(texts, batch.column(2), strict=True):
                if not own.is_valid:
                    removed.append(0), spans.append(0), kept.append(text)
                    continue
                start = np.asarray(own.values.field(0), np.int64)
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, np.minimum(start, len(text)), 1)
                np.add.at(edge, np.minimum(start + np.asarray(own.values.field(1), np.int64) + length - 1, len(text)), -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            ids = pa.array([None if i == _NO_ID else i for i in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return source.join(runs, ["doc", "variant"], "left").select("doc", "text", "runs").mapInArrow(keep, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
