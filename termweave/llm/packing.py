"""Bounded-space online best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written
from ._words import chunks
from .tokens import encoder

#: Sequences that one packing task fills, pieces that it holds at most, and tasks whose open bins are packed again together.
BINS_A_TASK, PIECES_A_TASK, TASKS_A_GROUP = 4096, 1_000_000, 64


class OpenBins:
    """A fixed number of open bins; bit f of ``free`` says that some open bin has f places free.

    ``place`` puts an item into the open bin with the least sufficient space. If none has room, a new bin opens; if
    ``limit`` are open already, the fullest closes first. Numbers count bins in the order of opening.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.free = capacity, limit, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.opened = 0

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number, and where in it the item lies."""
        roomy = self.free >> length
        if roomy:
            space = length + (roomy & -roomy).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space

    def still_open(self) -> set[int]:
        return {number for some in self.bins for number in some}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of every whole text's ids: doc_id, piece, start, length, ids_crc32; only longer documents are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch, texts in chunks(batches):
            ids, sizes = encode(texts, end_id)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = (np.cumsum(sizes) - sizes)[doc] + start
            view = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 64) -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths must be 1 to ``capacity``.

    Tasks get random shares of about ``BINS_A_TASK`` sequences each and pack them online, in an order fixed by a hash, so
    that reruns agree. Bins that are open when a task's items end (at most ``open_bins``) are packed once more, as items
    of their fill, over ``TASKS_A_GROUP`` tasks together. Repeated pieces are items of their own; no pieces give no rows.
    """
    pieces = written(pieces, "pieces")
    totals = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("ids"), F.count("*").alias("pieces")).first()
    tasks = max(1, -(-totals["ids"] // (capacity * BINS_A_TASK)), -(-totals["pieces"] // PIECES_A_TASK))
    columns = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

    def online(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, bins, held = None, OpenBins(capacity, open_bins), []
        for batch in batches:
            for own, part in batch.groupby("task", sort=False):
                if own != task:
                    yield from finished(task, bins, held)
                    task, bins, held = own, OpenBins(capacity, open_bins), []
                placed = np.array([bins.place(n) for n in part["length"].tolist()], np.int64).reshape(-1, 2)
                held.append(part.assign(bin=placed[:, 0], offset=placed[:, 1]))
        yield from finished(task, bins, held)

    def finished(task, bins: OpenBins, held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = list(bins.still_open())
        for part in held:
            yield part.assign(is_open=part["bin"].isin(left))

    dealt = pieces.withColumn("order", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("task", F.pmod(F.xxhash64(F.lit(7), "order"), F.lit(tasks)).cast("long"))
    ordered = dealt.repartition(tasks, "task").sortWithinPartitions("task", "order", "doc_id", "piece", "length")
    packed = written(ordered.mapInPandas(online, f"{columns}, order bigint, task bigint, bin bigint, offset bigint, is_open boolean").drop("order"), "packed")

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "task", "bin"], ascending=[False, True, True], kind="stable")
        bins = OpenBins(capacity, len(frame))
        placed = np.array([bins.place(n) for n in frame["fill"].tolist()], np.int64)
        return pd.DataFrame({"task": frame["task"], "bin": frame["bin"], "merged": frame["group"] * (TASKS_A_GROUP * open_bins) + placed[:, 0], "base": placed[:, 1]})

    left = packed.where("is_open").groupBy("task", "bin").agg(F.sum("length").alias("fill")).withColumn("group", F.floor(F.col("task") / TASKS_A_GROUP).cast("long"))
    merged = left.groupBy("group").applyInPandas(again, "task bigint, bin bigint, merged bigint, base bigint")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    closed = packed.where("not is_open").select(*names, (F.col("task") * F.lit(1 << 33) + F.col("bin") * 2).alias("sequence_id"), "offset")
    joined = packed.where("is_open").join(merged, ["task", "bin"]).select(*names, (F.col("merged") * 2 + 1).alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return closed.unionByName(joined)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, open_bins: int = 64, end_id: int = 1) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless in each sequence).

    A null text is empty (its end id alone); rows with a null or repeated doc_id are packed like any other; an empty
    table gives no rows; other columns are not read.
    """
    return best_fit_pack(token_pieces(docs, vocabulary, capacity, end_id), capacity, open_bins)
