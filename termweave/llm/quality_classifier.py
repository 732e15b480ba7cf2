"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairs of features interact through low-rank factors; the sum over all pairs is half of (sum of v x) squared minus the
sum of (v x) squared, so a document is scored in time linear in its features. The model is fitted on a bounded sample of
labelled rows and broadcast; its size is fixed by the number of hash buckets and factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import chunks, prefix_sums, span_hashes, word_spans

#: Buckets of hashed words and of word shapes; factors of a feature; labelled rows that are fitted at most.
BUCKETS, SHAPES, FACTORS, FIT_ROWS = 1 << 15, 256, 8, 12_000
STATISTICS = ("words", "word length", "upper case", "digits", "symbols", "line breaks", "bars", "exclamations", "distinct words", "characters")
FEATURES = BUCKETS + SHAPES + len(STATISTICS)

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in "#*$%&<>@^~=+{}[]\\/_"]] = 4
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 5
_KIND[ord("!")] = 6
_KIND[ord("|")] = 7
_KIND[128:] = 8


def features(texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its hashed features (indexes, values, how many) and the plain statistics, a row each.

    Distinct words weigh alike; values of a text's words and of its shapes (kinds of first and last character and
    whether they are all there is) have length 1 each.
    """
    buf, start, end, counts = word_spans(texts)
    hashes = span_hashes(prefix_sums(buf), start, end)
    doc = np.repeat(np.arange(len(texts)), counts)
    word = (hashes >> np.uint64(11)) % np.uint64(BUCKETS)
    first, last = _KIND[buf[start]] if len(start) else _KIND[:0], _KIND[buf[end - 1]] if len(start) else _KIND[:0]
    shape = np.uint64(BUCKETS) + (first.astype(np.uint64) * 9 + last + 81 * np.minimum(end - start, 3).astype(np.uint64)) % np.uint64(SHAPES)
    keys = (np.concatenate([doc, doc]).astype(np.uint64) << np.uint64(20)) | np.concatenate([word, shape])
    keys, many = np.unique(keys, return_counts=True)
    of, index = (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)
    is_shape = index >= BUCKETS
    raw = np.where(is_shape, many / np.maximum(counts[of], 1), 1.0)
    norm = np.sqrt(np.bincount(of * 2 + is_shape, raw * raw, 2 * len(texts)))
    values = raw / np.maximum(norm[of * 2 + is_shape], 1e-12)
    sizes = np.bincount(of, minlength=len(texts))

    kinds = np.zeros((len(texts), 9))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for kind in range(9):
        seen = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_KIND[buf] == kind, out=seen[1:])
        kinds[:, kind] = np.diff(seen[at])
    lines = np.array([t.count(b"\n") for t in texts], float)
    size = np.maximum([len(t) for t in texts], 1)
    distinct = np.bincount(of, ~is_shape, len(texts))
    chars = np.array([len(t) if n is None else max(n, 0) for t, n in zip(texts, n_chars, strict=True)], float)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    words = np.maximum(counts, 1)
    plain = np.stack([np.log1p(counts), size / words, kinds[:, 2] / letters, kinds[:, 3] / size, kinds[:, 4] / size, lines / words, kinds[:, 7] / words, kinds[:, 6] / words, distinct / words, np.log1p(chars)], axis=1)
    return index, values, sizes, plain


class Machine:
    """A fitted factorisation machine."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.bias = 0.0
        self.linear = np.zeros(FEATURES)
        self.factors = np.random.default_rng(17).normal(0, 0.02, (FEATURES, FACTORS))

    def inputs(self, index: np.ndarray, values: np.ndarray, sizes: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed features and scaled statistics in one list for each text."""
        n, m = plain.shape
        ends = np.cumsum(sizes)
        scaled = 0.4 * np.clip((plain - self.mean) / self.scale, -4, 4)
        at = np.repeat(ends, m)
        return np.insert(index, at, np.tile(np.arange(m) + BUCKETS + SHAPES, n)), np.insert(values, at, scaled.ravel()), sizes + m

    def margins(self, index: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.cumsum(sizes) - sizes
        weighted = self.factors[index] * values[:, None]
        sums = np.add.reduceat(weighted, first, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(weighted**2, first, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * values, first) + pairs, sums, weighted

    def scores(self, *of: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.inputs(*of))[0], -30, 30)))

    def fit(self, index: np.ndarray, values: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.15, batch: int = 128, decay: float = 1e-5) -> None:
        """Minimises log loss by Adagrad; rows come in a fixed random order each epoch."""
        first = np.cumsum(sizes) - sizes
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        past_linear, past_factors, past_bias = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6
        shuffle = np.random.default_rng(29)
        for _ in range(epochs):
            order = shuffle.permutation(len(sizes))
            for some in (order[i : i + batch] for i in range(0, len(order), batch)):
                own = sizes[some]
                at = np.repeat(first[some] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                idx, val = index[at], values[at]
                margin, sums, weighted = self.margins(idx, val, own)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
                each = np.repeat(error, own) * val
                used, where = np.unique(idx, return_inverse=True)
                step = np.bincount(where, each, len(used)) + decay * self.linear[used]
                past_linear[used] += step**2
                self.linear[used] -= rate * step / np.sqrt(past_linear[used])
                pull = each[:, None] * (np.repeat(sums, own, axis=0) - weighted)
                for f in range(FACTORS):
                    step = np.bincount(where, pull[:, f], len(used)) + decay * self.factors[used, f]
                    past_factors[used, f] += step**2
                    self.factors[used, f] -= 0.3 * rate * step / np.sqrt(past_factors[used, f])
                past_bias += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(past_bias)


def _texts(docs: DataFrame) -> list:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("text").cast("string").alias("text"), chars.alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fits ``labels`` (doc_id, label) on at most ``fit_rows`` labelled rows, those with the least hash of doc_id."""
    some = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_texts(docs)).join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(fit_rows).select("label", "text", "n_chars")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            index, values, sizes, plain = features(texts, batch.column(2).to_pylist())
            cut = np.cumsum(sizes)[:-1]
            columns = [batch.column(0), pa.array([x.astype(np.int32).tobytes() for x in np.split(index, cut)], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in np.split(values, cut)], pa.binary()), pa.array([x.tobytes() for x in plain], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "index", "value", "plain"])

    sample = rows.withColumn("label", F.col("label").cast("double")).mapInArrow(made, "label double, index binary, value binary, plain binary").toArrow()
    if not sample.num_rows:
        return Machine(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    index = [np.frombuffer(x, np.int32).astype(np.int64) for x in sample.column("index").to_pylist()]
    values = [np.frombuffer(x, np.float32).astype(np.float64) for x in sample.column("value").to_pylist()]
    plain = np.stack([np.frombuffer(x) for x in sample.column("plain").to_pylist()])
    machine = Machine(plain.mean(axis=0), plain.std(axis=0) + 1e-6)
    machine.fit(*machine.inputs(np.concatenate(index), np.concatenate(values), np.array([len(x) for x in index]), plain), sample.column("label").to_numpy())
    return machine


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, at_least: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text, perhaps n_chars).

    ``labels`` (doc_id, label 0 or 1) are learnt where crc32(doc_id as text) mod ``folds`` is not 0; the others are held
    out. Only text and n_chars make a score. A null text counts as empty and is scored, as are rows with a null doc_id
    (held out) or a repeated one. Without labels every score is 0.5; an empty table gives no rows.
    """
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    learnt = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where(remainder != 0)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, learnt, fit_rows))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            score = model.value.scores(*features(texts, batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= at_least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder == 0).alias("held_out"), *_texts(docs))
    return rows.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")
