"""Ranked lexical search over a bit-sliced impact index.

What a term adds to a document's score is a whole number, its impact. For a shard of documents a term's impacts are kept
as bitmaps, one for each bit, so that adding a term to the scores of all documents of the shard is carry arithmetic on
machine words. The highest scores are found by going down the slices of the sum from the most significant one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import removed, written
from ._words import chunks

#: Documents of a shard: 128 machine words a slice.
SHARD = 8192
#: Pairs of item and term that are asked at once; what a task holds grows with these, not with the table of items.
BLOCK_TERMS = 100_000
#: Items that a task adds up at once.
BLOCK_ITEMS = 256
# Fixed value: what a term consists of: ASCII digits and letters and all beyond ASCII, A-Z lower-cased.
_TERM_BYTE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTE).split()


def carry_save(total: np.ndarray, carry: np.ndarray, slices: np.ndarray) -> None:
    """Adds a number given as ``slices`` to one kept as ``total + carry``, all bits of all documents at once."""
    odd = total ^ carry
    majority = (total & carry) | (slices & odd)
    np.bitwise_xor(odd, slices, out=total)
    carry[1:] = majority[:-1]
    carry[0] = 0


def carried(total: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """The slices of ``total + carry``: one carry runs through all slices. Axes: number, slice, word."""
    out, held = np.empty_like(total), np.zeros_like(total[:, 0])
    for b in range(total.shape[1]):
        odd = total[:, b] ^ carry[:, b]
        out[:, b] = odd ^ held
        held = (total[:, b] & carry[:, b]) | (held & odd)
    return out


def sliced(places: np.ndarray, values: np.ndarray, n_bits: int, n_words: int) -> np.ndarray:
    """Bitmaps of the bits of ``values`` at the documents ``places`` (each once); axes: bit, word."""
    out = np.zeros((n_bits, n_words), np.uint64)
    bit, which = np.nonzero((values[None, :] >> np.arange(n_bits, dtype=np.int64)[:, None]) & 1)
    at = places[which]
    np.bitwise_or.at(out.reshape(-1), bit * n_words + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def top_places(slices: np.ndarray, k: int, everything: np.ndarray) -> np.ndarray:
    """Places of the ``k`` highest numbers above 0, of equal ones the first, unordered. Axes of ``slices``: bit, word.

    ``sure`` are those that lie above the k-th number for certain, ``open`` those that agree with it in all bits so far.
    """
    present = np.bitwise_or.reduce(slices, axis=0) & everything
    sure, open_ = np.zeros_like(present), present
    for row in slices[::-1]:
        ones = open_ & row
        more = sure | ones
        n = int(np.bitwise_count(more).sum())
        if n > k:
            open_ = ones
        else:
            sure, open_ = more, open_ & ~row
            if n == k:
                break
    found = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    tied = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
    return np.concatenate([found, tied[: max(0, k - len(found))]])


def numbers_at(slices: np.ndarray, places: np.ndarray) -> np.ndarray:
    bits = (slices[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return (bits << np.arange(len(slices), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)


def _postings(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs: the asked terms of every document that has any term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for batch, texts in chunks(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for text in texts:
                own = terms_of(text)
                counted = Counter([t for w in own if (t := get(w)) is not None])
                sizes.append(len(own))
                terms += counted.keys()
                tfs += counted.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n long, terms array<int>, tfs array<long>")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each ``SHARD`` documents: ids and null flags in order of ids, lengths, and their postings by term (term, place, tf)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def shard() -> tuple:
        table = pa.Table.from_batches(held)
        ids = table.column("doc_id").combine_chunks()
        null, values = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
        order = np.lexsort((values, null))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        place = np.repeat(rank, terms.value_lengths().to_numpy())
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        by_term = np.argsort(term, kind="stable")
        return values[order], null[order], table.column("n").to_numpy()[order], term[by_term], place[by_term], tf[by_term]

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SHARD - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == SHARD:
                yield shard()
                held, size = [], 0
    if held:
        yield shard()


def _search(postings: DataFrame, asked, weights, lengths: tuple[int, int], k: int, b: int, k1: int, n_bits: int) -> DataFrame:
    """item (its number), no_id, doc_id, score: the best ``k`` of each task's documents for every item."""
    n_docs, n_terms = lengths

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = asked.value, weights.value
        best = {}  # item: its best documents in the task's shards so far
        for ids, null, n, term, place, tf in _shards(batches):
            m = 100 - b + (b * n * n_docs) // n_terms
            n_words = -(-len(ids) // 64)
            everything = np.packbits(np.arange(n_words * 64) < len(ids), bitorder="little").view(np.uint64)
            cuts = np.flatnonzero(np.diff(term, prepend=-1))
            index = {int(term[a]): (a, e) for a, e in zip(cuts, [*cuts[1:], len(term)])}
            for first in range(0, len(items), BLOCK_ITEMS):
                block = items[first : first + BLOCK_ITEMS]
                total, carry = np.zeros((2, len(block), n_bits, n_words), np.uint64)
                holders = {}
                for i, own in enumerate(block):
                    for t in own:
                        if t in index:
                            holders.setdefault(t, []).append(i)
                for t, who in holders.items():
                    a, e = index[t]
                    impact = w[t] * ((1_000_000_000 * tf[a:e]) // (1000 * tf[a:e] + k1 * m[place[a:e]]))
                    slices = sliced(place[a:e], impact, n_bits, n_words)
                    for i in who:
                        carry_save(total[i], carry[i], slices)
                for i, slices in enumerate(carried(total, carry)):
                    at = top_places(slices, k, everything)
                    if not len(at):
                        continue
                    new = np.stack([-numbers_at(slices, at), null[at].astype(np.int64), ids[at]])
                    known = best.get(first + i)
                    both = new if known is None else np.concatenate([known, new], axis=1)
                    best[first + i] = both[:, np.lexsort(both[::-1])[:k]]
        for item, rows in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], item, np.int32)), pa.array(rows[1] == 1), pa.array(rows[2]), pa.array(-rows[0])], ["item", "no_id", "doc_id", "score"])

    return postings.mapInArrow(task, "item int, no_id boolean, doc_id long, score long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, its distinct terms) in blocks of about ``BLOCK_TERMS`` terms; an item is never cut."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("item_id")), pa.array([sorted(set(terms_of(t))) for t in texts], pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    cut = items.select("item_id", "text").mapInArrow(task, f"item_id {kind}, terms array<binary>").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    block, size = [], 0
    for row in cut.orderBy("item_id").toLocalIterator():
        block.append((row["item_id"], [bytes(t) for t in row["terms"]]))
        size += len(row["terms"])
        if size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50, b: int = 50, k1: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of ``docs`` (doc_id, text) that score highest for each of ``items`` (item_id, text).

    With N documents that have a term, L their terms and n one document's terms (repeats count), df the documents that
    hold a term and tf how often one does: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 100 - b + (b n N) div L, and the
    score sums w * ((10^9 tf) div (1000 tf + k1 m)) over an item's terms, each once. Scores of 0 are left out; equal
    scores rank by doc_id, null last. Null texts have no terms. Each row of ``docs`` is a document, also where a doc_id
    repeats; rows of one item_id (also null) are one item with all their terms. Other columns are left out. Empty tables
    give no rows.

    Items are asked in blocks of terms, all documents for each block. Of every document only the asked terms are kept, as
    a table from which each task builds the slices of its shards and searches them; df, N and L are sums over it. A task
    sends on ``k`` rows an item. Scores stay below 2^63; more than that is an error.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    found = None
    for number, block in enumerate(_blocks(items)):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, own in block for t in own))}
        numbers = spark.sparkContext.broadcast(vocabulary)
        postings = written(_postings(docs, numbers), "postings")
        sums = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not sums["docs"]:
            removed(postings)
            break
        dfs = {r["t"]: r["df"] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weights = {t: weight(sums["docs"], df) for t, df in dfs.items()}
        asked = [[t for x in own if (t := vocabulary[x]) in weights] for _, own in block]
        n_bits = max(1, max((sum(weights[t] for t in own) * 1_000_000).bit_length() for own in asked))
        if n_bits > 63:
            raise ValueError("an item's scores may pass 64 bits: fewer terms an item, please")
        best = _search(postings, spark.sparkContext.broadcast(asked), spark.sparkContext.broadcast(weights), (sums["docs"], sums["terms"]), k, b, k1, n_bits)
        names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind}"))
        order = F.col("score").desc(), "no_id", "doc_id"
        # in two steps, so that no task meets the finds of all tasks for an item
        some = best.withColumn("_part", F.spark_partition_id() % 64)
        some = some.withColumn("_place", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("_place") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        part = written(ranked.join(names, "item").select("item_id", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score"), "ranked")
        removed(postings)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found
