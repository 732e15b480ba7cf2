"""Token-ID output: patched frame-of-reference (PFOR) shard files of whole tokenised documents.

A shard is one binary value in a Parquet row group, so any store that Spark writes holds it and Spark's commit
protocol keeps a lost executor from leaving half a file. Layout of a shard, little-endian:

    magic "PFR1" | u32 ids | u32 block length | u32 blocks | u64 start of each block, from the shard's first byte
    block: u32 minimum | u8 width | u16 exceptions | low bits, 64 ids in ``width`` words | u16 places | u32 high bits

Every block subtracts its minimum, packs at the width that a fixed percentile of its ids needs, and keeps the high bits
of the rest as exceptions. The index of block starts gives any id without reading the blocks before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written
from ._words import chunks
from .tokens import encoder

_HEAD = struct.Struct("<4sIII")
_BLOCK = struct.Struct("<IBH")


def _lane_words(block: int, width: int) -> int:
    """64-bit words of a block's low bits: each 64 values take ``width`` words."""
    return -(-block // 64) * width


def _lanes(values: np.ndarray, width: int) -> np.ndarray:
    """The values of each row, ``width`` bits each, from the lowest bit of the first word on."""
    n, block = values.shape
    lanes = -(-block // 64)
    wide = np.zeros((64, n * lanes), np.uint64)
    padded = np.zeros((n, lanes * 64), np.uint64)
    padded[:, :block] = values
    wide[:] = padded.reshape(n * lanes, 64).T
    out = np.zeros((width, n * lanes), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= wide[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= wide[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(n, lanes * width).astype("<u8", copy=False)


def _from_lanes(words: np.ndarray, width: int, block: int) -> np.ndarray:
    """What ``_lanes`` packed."""
    n = len(words)
    packed = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, packed.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[i] = packed[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= packed[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(n, -1)[:, :block].astype(np.uint32)


def encode_shard(ids: np.ndarray, block: int = 512, percentile: float = 0.95) -> bytes:
    """``ids`` (below 2**32) as a shard."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n_blocks = -(-len(ids) // block)
    padded = np.full(n_blocks * block, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n_blocks, block)
    low = rows.min(axis=1) if n_blocks else np.empty(0, np.uint32)
    rest = rows - low[:, None]
    rank = min(block - 1, int(percentile * block))
    at_percentile = np.partition(rest, rank, axis=1)[:, rank] if n_blocks else low
    widths = np.ceil(np.log2(at_percentile.astype(np.float64) + 1)).astype(np.uint8)
    packed: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths[widths > 0]).tolist():
        of = np.flatnonzero(widths == width)
        for i, row in zip(of.tolist(), _lanes(rest[of] & np.uint32((1 << width) - 1), width), strict=True):
            packed[i] = row.tobytes()
    high = rest >> widths[:, None].astype(np.uint32) if n_blocks else rest
    block_of, place = np.nonzero(high)
    bounds = np.searchsorted(block_of, np.arange(n_blocks + 1))
    place, high = place.astype("<u2"), high[block_of, place].astype("<u4")
    body, starts, at = [], [], _HEAD.size + 8 * n_blocks
    for i in range(n_blocks):
        a, b = bounds[i], bounds[i + 1]
        raw = b"".join((_BLOCK.pack(int(low[i]), int(widths[i]), int(b - a)), packed[i], place[a:b].tobytes(), high[a:b].tobytes()))
        starts.append(at)
        at += len(raw)
        body.append(raw)
    return b"".join((_HEAD.pack(b"PFR1", len(ids), block, n_blocks), np.array(starts, "<u8").tobytes(), *body))


def decode_shard(raw: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """Ids of a shard, or of some of its blocks, found by the index."""
    magic, n_ids, block, total = _HEAD.unpack_from(raw)
    if magic != b"PFR1":
        raise ValueError("not a token shard")
    last = total if n_blocks is None else min(total, first_block + n_blocks)
    starts = np.frombuffer(raw, "<u8", total, _HEAD.size)
    n = max(0, last - first_block)
    rest = np.zeros((n, block), np.uint32)
    heads = [_BLOCK.unpack_from(raw, int(starts[first_block + i])) for i in range(n)]
    widths = np.array([w for _, w, _ in heads], np.uint8)
    for width in np.unique(widths[widths > 0]).tolist():
        of = np.flatnonzero(widths == width)
        rest[of] = _from_lanes(np.stack([np.frombuffer(raw, "<u8", _lane_words(block, width), int(starts[first_block + i]) + _BLOCK.size) for i in of]), width, block)
    for i, (low, width, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[first_block + i]) + _BLOCK.size + 8 * _lane_words(block, width)
            place = np.frombuffer(raw, "<u2", exceptions, at)
            rest[i, place] |= np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
        rest[i] += np.uint32(low)
    return rest.reshape(-1)[: max(0, min(n_ids, last * block) - first_block * block)]


def encode_file(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A file: the bytes of the ids' shard (u64), that shard, and a shard with the ids of each document."""
    shard = encode_shard(ids)
    return struct.pack("<Q", len(shard)) + shard + encode_shard(counts)


def decode_file(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a file, and how many each of its documents has."""
    size = struct.unpack_from("<Q", raw)[0]
    return decode_shard(raw[8 : 8 + size]), decode_shard(raw[8 + size :])


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, shard_ids: int = 1 << 20) -> DataFrame:
    """Tokenises every whole ``text`` and writes shards of at most about ``shard_ids`` ids; returns the table written.

    Documents are range-sorted by ``doc_id`` and shards are numbered ``(part, seq)`` in that order. Rows:
    part, seq, doc_ids, n_ids, payload (``encode_file``: ids and each document's number of them, its end id included).
    A null text is empty (its end id alone), null doc_ids come first, repeated doc_ids stay rows of their own, ordered
    by a hash of the text, an empty table gives no shard. A document longer than a shard has a shard to itself. Other
    columns are not read.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids, sizes = np.concatenate(held), np.concatenate(counts)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([list(keys)], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode_file(ids, sizes)], pa.binary())]
            keys.clear(), counts.clear(), held.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "doc_ids", "n_ids", "payload"])

        for batch, texts in chunks(batches):
            ids, sizes = encode(texts, end_id)
            keys += batch.column(0).to_pylist()
            counts.append(sizes)
            held.append(ids)
            if sum(map(len, held)) >= shard_ids:
                yield flush()
                seq += 1
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one doc_id, or of none, may lie in several ranges
    by_text = ordered.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return written(by_text.mapInArrow(shards, "part int, seq int, doc_ids array<bigint>, n_ids bigint, payload binary"), "token-shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Offsets are summed over parts (one row for each task that wrote) and then inside each part, so no task sees all
    shards.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("base"))
    inside = shards.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inner"))
    place = inside.join(before, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, raw, first = (batch.column(i)[row] for i in range(3))
                ids, counts = decode_file(raw.as_py())
                ids, counts = ids.astype("<u4"), counts.astype(np.int64)
                ends = np.cumsum(counts)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(first.as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(place, ["part", "seq"]).select("doc_ids", "payload", "first").mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
