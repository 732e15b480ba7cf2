"""Exact top-k inner-product search: a ball tree for each shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id, so that equal or clustered vectors never gather in one. A shard's tree
stands in one task, and the queries pass it in blocks: all of them, which is the stated query set against all rows. In a
tree, nodes are visited in the order of the largest inner product that their ball allows, q.c + |q| r, and left out once
that is below the k-th score. That score is shared: each query searches one shard first, and carries what it found there
to all the others. So trees are moved twice whatever the number of queries, and a query once for each shard; shards grow
with the table, to a bound, before their number does.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

BLOCK_QUERIES, LEAF_ROWS = 1024, 512
#: Shards, while each has rows within these bounds.
SHARDS, LEAST_ROWS, MOST_ROWS = 64, 8192, 65_536
#: Scores below this are exact sums of doubles.
_EXACT = float(1 << 53)


class BallTree:
    """Nodes of a shard's vectors in arrays; children lie in ``children``, leaves have -1 there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        bounds, children, centers, radii = [], [], [], []

        def grow(a: int, b: int) -> int:
            node = len(bounds)
            own = vectors[order[a:b]]
            center = own.mean(axis=0)
            apart = np.sqrt(((own - center) ** 2).sum(axis=1))
            bounds.append((a, b))
            centers.append(center)
            radii.append(float(apart.max()))
            children.append((-1, -1))
            if b - a > leaf and radii[-1] > 0:
                first = own[int(apart.argmax())]
                second = own[int(((own - first) ** 2).sum(axis=1).argmax())]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (second - first), half)]
                children[node] = (grow(a, a + half), grow(a + half, b))
            return node

        grow(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.bounds, self.children = bounds, children
        self.centers, self.radii = np.array(centers), np.array(radii)

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, vector, score) of at most k vectors for each query that score ``least`` or more."""
        size = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * self.vectors.shape[1]
        stored = self.vectors if size < _EXACT else np.vectorize(int, otypes=[object])(self.vectors)
        most = queries @ self.centers.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radii[None, :]
        most += 1e-6 + 1e-9 * np.abs(most)
        for query, vector, bound, floor in zip(ids.tolist(), queries, most, least.tolist(), strict=True):
            asked = vector if size < _EXACT else np.vectorize(int, otypes=[object])(vector)
            best: list[tuple[int, int]] = []
            todo = [(-bound[0], 0)]
            while todo and -todo[0][0] >= floor:
                node = heapq.heappop(todo)[1]
                left, right = self.children[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= floor:
                            heapq.heappush(todo, (-bound[child], child))
                    continue
                a, b = self.bounds[node]
                scores = stored[a:b] @ asked
                good = np.flatnonzero(scores >= floor)
                best += [(-int(scores[i]), int(self.ids[a + i])) for i in good if self.ids[a + i] != query]
                if len(best) >= k:
                    best = heapq.nsmallest(k, best)
                    floor = max(floor, -best[-1][0])
            for negative, own in heapq.nsmallest(k, best):
                yield query, own, max(-(1 << 63), min((1 << 63) - 1, -negative))


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, vector: floor(256 x) of every component as doubles; vectors that take no part are left out."""
    for batch in batches:
        ids, dims, rows = [], [], []
        for vec_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if vec_id is None or not raw.is_valid or raw.values.null_count:
                continue
            x = np.asarray(raw.values, np.float64)
            if len(x) and np.isfinite(x).all():
                ids.append(vec_id)
                dims.append(len(x))
                rows.append(np.clip(np.floor(256 * x), -_EXACT, _EXACT).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(rows, pa.binary())], ["vec_id", "dim", "vector"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, its k best other rows: query_id, rank, vec_id, score.

    Components count as floor(256 x). Score: inner product; ties go to the smaller vec_id. Rows without a vec_id and
    vectors that are null, empty or hold null or non-finite components take no part; vectors meet those of their own
    length alone. Components beyond 2**53 count as 2**53, scores beyond 64 bits as the largest. Rows that repeat a
    vec_id are candidates each; as a query the id counts once, with its least vector, and rows of its id aren't its
    candidates. Fewer than k candidates give all; an empty table gives no rows. Columns other than vec_id and embedding
    are not read.
    """
    # one batch of vectors becomes rows of bytes once; all that follows reads the table
    ready = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_quantised, "vec_id bigint, dim int, vector binary"), "vectors")
    asked = ready.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select(F.col("vec_id").alias("query_id"), "v.dim", "v.vector")
    n = ready.count()
    shards = max(1, -(-n // min(MOST_ROWS, max(LEAST_ROWS, -(-n // SHARDS)))))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def tree() -> pa.RecordBatch:
            made = BallTree(np.array(ids, np.int64), np.frombuffer(b"".join(rows), np.float64).reshape(len(ids), -1))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], ["shard", "dim", "tree"])

        for batch in batches:
            for shard, dim, vec_id, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (shard, dim) != key:
                    if ids:
                        yield tree()
                    key, ids, rows = (shard, dim), [], []
                ids.append(vec_id)
                rows.append(raw)
        if ids:
            yield tree()

    dealt = ready.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")).select("shard", "dim", "vec_id", "vector")
    trees = written(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "vec_id").mapInArrow(grown, "shard int, dim int, tree binary"), "trees")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, held = None, None, []

        def found() -> pa.RecordBatch:
            ids, vectors, least = zip(*held, strict=True)
            rows = np.frombuffer(b"".join(vectors), np.float64).reshape(len(ids), -1)
            best = list(tree.search(np.array(ids, np.int64), rows, np.array([-np.inf if x is None else x for x in least]), k))
            columns = zip(*best, strict=True) if best else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for shard, dim, raw, *query in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and ((shard, dim) != key or len(held) == BLOCK_QUERIES):
                    yield found()
                    held = []
                if raw is not None:
                    key, tree = (shard, dim), pickle.loads(raw)
                elif (shard, dim) == key:  # else the shard has no vector of this length
                    held.append(query)
        if held:
            yield found()

    home = F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")

    def search(queries: DataFrame, shard: Column) -> DataFrame:
        # a tree comes before the queries of its length
        sent = queries.select(shard.alias("shard"), "dim", F.lit(None).cast("binary").alias("tree"), "query_id", "vector", "least")
        stands = trees.select("*", F.lit(None).cast("bigint").alias("query_id"), F.lit(None).cast("binary").alias("vector"), F.lit(None).cast("double").alias("least"))
        met = stands.unionByName(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", F.col("tree").isNull())
        return met.mapInArrow(searched, "query_id bigint, vec_id bigint, score bigint")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = written(search(asked.withColumn("least", F.lit(None).cast("double")), home), "home-scores")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    others = search(asked.join(kth.hint("merge"), "query_id", "left"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda x: x != home)))
    ranked = first.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
