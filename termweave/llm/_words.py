"""Whole texts in Arrow batches: bytes, words and 64-bit word hashes, with numpy over many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are handled at once, beside the document that reaches over it.
CHUNK_BYTES = 2 << 20
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about ``CHUNK_BYTES`` of the column ``text``, each with its texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        data = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        start = size = 0
        texts: list[bytes] = []
        for row, value in enumerate(data):
            raw = value.as_py() or b""
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield batch.slice(start, row + 1 - start), texts
                start, size, texts = row + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def word_lists(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in a row, and how many each text has.

    ``bytes.split()`` parts at exactly these six characters.
    """
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split()
        counts[i] = len(own)
        words += own
    return words, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, size: int, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all ``size`` consecutive values: a polynomial modulo 2**64, by doubling, then scrambled.

    ``values`` must be scrambled 64-bit hashes already. Element i covers values i .. i+size-1; the result is
    ``size - 1`` shorter. Windows over document borders are the caller's to leave out.
    """
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, length, block = np.uint64(multiplier), 1, values
        out, done, rest = None, 0, size
        while rest:
            if rest & 1:
                out = block if out is None else out[: len(block) - done] * power + block[done:]
                done += length
            rest >>= 1
            if rest:
                block = block[:-length] * power + block[length:]
                power, length = power * power, length * 2
        return mix(out[:n])


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and lengthened as needed."""
    if len(_kept.get(base, ())) < n:
        values = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)), base, np.uint64)
        values[0] = 1
        with np.errstate(over="ignore"):
            _kept[base] = np.multiply.accumulate(values)
    return _kept[base][:n]


_kept: dict[int, np.ndarray] = {}
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums s with which ``span_hashes`` hashes any span of the bytes ``buf``; one element more than ``buf``."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * _powers(_P, len(buf)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans start .. end, equal wherever equal bytes lie."""
    with np.errstate(over="ignore"):
        unshifted = (sums[end] - sums[start]) * _powers(_P_INVERSE, len(sums))[start]
        return mix(unshifted + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined by a space each: the bytes, starts and ends of all words, and how many words each text has."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.zeros(len(buf) + 1, bool)
    inside[1:] = ~_IS_SPACE[buf]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, start, end, np.diff(np.searchsorted(start, borders))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and how many words each text has."""
    buf, start, end, counts = word_spans(texts)
    return span_hashes(prefix_sums(buf), start, end), counts


def variant_of(text: Column) -> Column:
    """Tells texts of one doc_id, or without one, apart: 63 bits of a hash. Rows that meet here would share their spans."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1))


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
