"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

A document's set are its distinct word shingles, and the universe of shingles is hashed into segments so narrow that a
segment holds one shingle of a set. Linked sets lie in one size band or two neighbouring ones. If a set of n shingles
links with another, at most H(n) of its non-empty segments are empty in the other one; so of any H(n) + 1 segments to
which it gives threshold 1, some segment is equal in both and its signature finds the pair.

Allocation goes by cost. A segment costs as many candidates as other sets have it. Segments that no other set has cost
nothing and are given a threshold first: they use up H at once. The rest of the H(n) + 1 thresholds goes to the rarest
segments, in an order that is the same for all sets, and all others, such as a passage that many documents share, get
none. The neighbours by one deletion of a segment with one shingle are the empty segment, which all other sets have: its
cost is the whole corpus, so threshold 2 is never allotted. (Wider segments make these neighbourhoods useful, but must
be given a threshold nearly all, common ones too, before some pair is sure to be found.)

Sets of a signature and band are paired with one leader, the one whose segments are the most common: the centre of a
group of near copies. What lies in different components after that is paired again, where counts still allow a link.
Candidates are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import removed, written
from ._words import chunks, gram_hashes, mix, to_signed, word_hashes
from .components import connected_components

#: Signatures gathered before they are dealt to buckets.
GATHER = 2_000_000
#: Low bytes of a signature that travel; its bucket stands for more. Signatures taken for one only add candidates.
KEPT_BYTES = 6
#: Sets of one gathering that share a signature from which on it is dealt apart from its bucket.
HOT = 128
#: Sets of a hot signature that travel as one part.
PART = 256
#: Rounds, after the first, that pair the sets of a signature with a leader before all that are still apart are paired.
STAR_ROUNDS = 1
#: Bits of a set's sketch.
SKETCH = 512


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; fewer words than ``size`` are one shingle."""
    words, counts = word_hashes([t.lower() for t in texts])
    grams = gram_hashes(words, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            own = np.sort(grams[at : at + n - size + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif n:
            out.append(gram_hashes(words[at : at + n], n) + np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _fingerprint(shingles: np.ndarray, seed: int = 0x51ED270B35A1C6F3) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles ^ np.uint64(seed)).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _nodes(source: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a fingerprint of the set) and check (another one) for every row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = shingle_sets(texts, size)
            columns = [[len(s) for s in found], [_fingerprint(s) for s in found], [_fingerprint(s, 0x2F0B4C47A1D3E695) for s in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "text_hash", "n_shingles", "node", "check"])

    return source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sets, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, check bigint")


def _signatures(source: DataFrame, size: int, buckets: int) -> DataFrame:
    """bucket, hot, packed: the sets that have signatures in a bucket, and (signature, which set) for each.

    A signature of ``HOT`` or more sets gathered at once goes to any buckets, in parts of ``PART`` sets marked as hot, with
    the number of the gathering; in its own bucket stands one row of no set, with the count of these sets as negative n.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        gather = TaskContext.get().partitionId() << 32

        def packed(signature: np.ndarray, owner: np.ndarray, about: np.ndarray) -> bytes:
            here, which = np.unique(owner, return_inverse=True)
            small = np.uint16 if len(here) < 1 << 16 else np.uint32
            return b"".join((np.array([len(here), len(signature)], np.int64).tobytes(), about[here].tobytes(), signature.view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes(), which.astype(small).tobytes()))

        def flush() -> pa.RecordBatch:
            sets = list(held.values())
            about = np.array([(node, len(s)) for node, s in held.items()], np.int64)
            signature = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(signature)
            signature, owner = signature[order], owner[order]
            first = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]])
            run = np.diff(first, append=len(signature))
            hot = np.repeat(run >= HOT, run)
            rows, keys, is_hot = [], [], []
            # the top bits deal signatures to buckets, in order
            if hot.any():
                own, theirs = signature[hot], owner[hot]
                edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                parts = [(c, min(c + PART, b)) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True) for c in range(a, b, PART)]
                for i, (a, b) in enumerate(parts):
                    own_bucket = int(((own[a] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32))
                    rows.append(np.int64(gather).tobytes() + _whole(own[a : a + 1].view(np.uint8).reshape(1, 8)[:, :KEPT_BYTES], own_bucket).tobytes() + packed(own[a:b], theirs[a:b], about))
                    keys.append(int(mix(own[a : a + 1] + np.uint64(about[0, 0] & 0xFFFF) + np.uint64(i))[0] % np.uint64(buckets)))
                    is_hot.append(True)
                # the rows of no set, one entry for each count
                counts, which = np.unique(np.diff(edges, append=len(own)), return_inverse=True)
                about = np.concatenate((about, np.stack((np.zeros_like(counts), -counts), 1)))
                signature, owner = np.r_[signature[~hot], own[edges]], np.r_[owner[~hot], (len(sets) + which).astype(np.uint32)]
            bucket = ((signature >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            bucket, signature, owner = bucket[order], signature[order], owner[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(bucket)], strict=True):
                rows.append(packed(signature[a:b], owner[a:b], about))
                keys.append(int(bucket[a]))
                is_hot.append(False)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(is_hot), pa.array(rows, pa.binary())], ["bucket", "hot", "packed"])

        for _, texts in chunks(batches):
            for own in shingle_sets(texts, size):
                node = _fingerprint(own) if len(own) else 0
                if len(own) and node not in held:
                    held[node] = mix(own)
                    total += len(own)
            if total >= GATHER:
                yield flush()
                total = 0
                gather += 1
        if held:
            yield flush()

    return source.mapInArrow(dealt, "bucket int, hot boolean, packed binary")


def _whole(low: np.ndarray, bucket: int) -> np.ndarray:
    whole = np.empty((len(low), 8), np.uint8)
    whole[:, :KEPT_BYTES] = low
    whole[:, KEPT_BYTES:] = np.array([bucket], np.uint32).view(np.uint8)[: 8 - KEPT_BYTES]
    return whole.view(np.uint64).ravel()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Low bytes of the signatures as rows, and node and n of their sets."""
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    about = np.frombuffer(raw, np.int64, 2 * n, 16).reshape(n, 2)
    at = 16 + 16 * n
    low = np.frombuffer(raw, np.uint8, KEPT_BYTES * m, at).reshape(m, KEPT_BYTES)
    return low, about[np.frombuffer(raw, np.uint16 if n < 1 << 16 else np.uint32, m, at + KEPT_BYTES * m)]


def _groups(packed: DataFrame) -> DataFrame:
    """signature, node, n, members, total, gather, sets: signatures that two or more sets have, in three kinds of rows.

    One is a set and the signature's members. For hot signatures, one has the ``total`` of members over all gatherings (a
    set that was gathered more than once counts so often: the count orders signatures alike for all sets, no more), and
    one a part of the ``sets`` (node, n) of one gathering.
    """
    pair = pa.struct([("node", pa.int64()), ("n", pa.int64())])
    columns = {"signature": pa.int64(), "node": pa.int64(), "n": pa.int64(), "members": pa.int64(), "total": pa.int64(), "gather": pa.int64(), "sets": pa.list_(pair)}

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, hot_parts, total = None, [], [], 0
        for batch in batches:
            for own, hot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if hot:
                    data = raw.as_py()
                    hot_parts.append((*np.frombuffer(data, np.int64, 2).tolist(), _unpacked(data[16:])[1]))
                    total += len(hot_parts[-1][2])
                    if total >= 100 * PART:
                        yield parts(*zip(*hot_parts, strict=True))
                        hot_parts, total = [], 0
                    continue
                if own != bucket:
                    yield from found(bucket, held)
                    bucket, held = own, []
                held.append(raw.as_py())
        yield from found(bucket, held)
        if hot_parts:
            yield parts(*zip(*hot_parts, strict=True))

    def batch(**given: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(size, kind)) for c, kind in columns.items()], list(columns))

    def numbers(about: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.ascontiguousarray(c)) for c in about.T]

    def parts(gathers: tuple[int, ...], signatures: tuple[int, ...], abouts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, abouts)])
        sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(numbers(np.concatenate(abouts)), fields=list(pair)))
        return batch(gather=pa.array(gathers, pa.int64()), signature=pa.array(signatures, pa.int64()), sets=sets)

    def found(bucket: int | None, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        lows, abouts = zip(*map(_unpacked, held), strict=True)
        signature, about = _whole(np.concatenate(lows), bucket), np.concatenate(abouts)
        mark = about[:, 1] < 0
        marked, which = np.unique(signature[mark], return_inverse=True)
        elsewhere = np.zeros(len(marked), np.int64)
        np.add.at(elsewhere, which, -about[mark, 1])
        order = np.argsort(signature)
        # a hot signature's row of no set makes it repeated
        signature = signature[order]
        same = signature[1:] == signature[:-1]
        repeated = np.zeros(len(signature), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        repeated &= ~mark[order]
        signature, about = signature[repeated], about[order[repeated]]
        order = np.lexsort((about[:, 0], signature))
        signature, about = signature[order], about[order]
        fresh = np.ones(len(signature), bool)
        fresh[1:] = (signature[1:] != signature[:-1]) | (about[1:, 0] != about[:-1, 0])
        signature, about = signature[fresh], about[fresh]
        first = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]][: len(signature)])
        here = np.diff(first, append=len(signature))
        size = here.copy()
        if len(marked):
            _, a, b = np.intersect1d(signature[first], marked, assume_unique=True, return_indices=True)
            size[a] += elsewhere[b]
            elsewhere[b] += here[a]
            yield batch(signature=pa.array(to_signed(marked)), total=pa.array(elsewhere))
        members = np.repeat(size, here)
        keep = members > 1
        if keep.any():
            node, n = numbers(about[keep])
            yield batch(signature=pa.array(to_signed(signature[keep])), node=node, n=n, members=pa.array(members[keep]))

    return packed.mapInArrow(gathered, "signature bigint, node bigint, n bigint, members bigint, total bigint, gather bigint, sets array<struct<node: bigint, n: bigint>>")


def _counted(groups: DataFrame) -> DataFrame:
    """gather, signature, members, sets: the parts of hot signatures, each with the count of its signature over all."""
    counts = groups.where("total is not null").select("signature", F.col("total").alias("members"))
    return groups.where("gather is not null").select("gather", "signature", "sets").join(counts, "signature")


def _hot_lists(groups: DataFrame) -> DataFrame:
    """node, n, hot (members, signature): the hot signatures of each set of a gathering, from its parts.

    A gathering has ``GATHER`` entries and those of one chunk of texts more, so a group has a bound.
    """

    def listed(parts: pa.Table) -> pa.Table:
        sets = parts["sets"].combine_chunks()
        size, entries = sets.value_lengths().to_numpy(), sets.flatten()
        node, n = (entries.field(c).to_numpy() for c in ("node", "n"))
        order = np.argsort(node, kind="stable")
        node, n = node[order], n[order]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        own = [pa.array(np.repeat(parts[c].to_numpy(), size)[order]) for c in ("members", "signature")]
        hot = pa.ListArray.from_arrays(pa.array(np.r_[first, len(node)], pa.int32()), pa.StructArray.from_arrays(own, ["members", "signature"]))
        return pa.table({"node": node[first], "n": n[first], "hot": hot})

    return _counted(groups).groupBy("gather").applyInArrow(listed, "node bigint, n bigint, hot array<struct<members: bigint, signature: bigint>>")


def _open_sets(groups: DataFrame, percent: int) -> DataFrame:
    """node, n, common, weight, own (members, signature; rarest first) of all sets that may link.

    ``own`` are the signatures that other sets have too, ``common`` their number, ``weight`` how common they are.
    """
    known = groups.where("node is not null").select("node", "n", F.struct("members", "signature").alias("one"))
    known = known.unionByName(_hot_lists(groups), allowMissingColumns=True)
    own = F.sort_array(F.concat(F.collect_list("one"), F.flatten(F.collect_list("hot"))))
    own = known.groupBy("node").agg(F.first("n").alias("n"), own.alias("own"))
    # what a set has from several gatherings stands side by side
    own = own.withColumn("own", F.filter("own", lambda x, i: (i == 0) | (x["signature"] != F.get("own", i - 1)["signature"])))
    weight = F.aggregate("own", F.lit(0.0), lambda total, x: total + F.log2(x["members"].cast("double"))) / F.col("n")
    return own.select("node", "n", F.size("own").cast("long").alias("common"), weight.alias("weight"), "own").where(F.col("common") * 100 >= percent * F.col("n"))


def _allotted(sets: DataFrame, percent: int) -> DataFrame:
    """signature, band, node, n, common, weight, place: the segments of ``sets`` that have threshold 1.

    ``place`` is the segment's in the order by cost. A set stands in its own band and the one below, so that linked sets
    meet in the smaller one's.
    """
    width = F.lit(max(float(np.log(100 / percent)) * 1.001, 1e-3))
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    thresholds = F.floor((100 - percent) * F.col("n") / 100) + 1 - (F.col("n") - F.col("common"))
    bands = F.explode(F.array("own_band", F.col("own_band") - 1)).alias("band")
    sets = sets.withColumn("own_band", band).withColumn("own", F.slice(F.col("own.signature"), F.lit(1), thresholds.cast("int")))
    rows = sets.select("node", "n", "common", "weight", "own_band", F.posexplode("own").alias("place", "signature"))
    return rows.select("signature", bands, "own_band", "node", "n", "common", "weight", (F.col("n") - F.col("common") + F.col("place")).alias("place"))


def _enough(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return shared * (100 + percent) >= F.lit(percent) * (n_a + n_b)


def _distinct_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, n_a, n_b of ``rows`` (a row for each segment that two sets share) that may link by their places.

    The rarest shared segment bounds what two sets share: nothing before it, and what is left from there of either.
    """
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = rows.groupBy("a", "b").agg(F.max(left).alias("most"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return pairs.where(_enough(F.col("most"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, decided on all signatures of both sets that any other set has."""
    shingles = sets.select("node", F.col("own.signature").alias("shingles"))
    left = pairs.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return both.where(_enough(shared, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _several(rows: DataFrame) -> DataFrame:
    """``rows`` of the signatures and bands whose sets lie in two or more components and may link by their counts."""
    for _ in range(2):
        groups = rows.groupBy("signature", "band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("n").alias("smallest"))
        rows = rows.join(groups.where("least <> most").drop("least", "most"), ["signature", "band"])
        rows = rows.where("enough_for >= smallest").drop("smallest")
    return rows


def _sketched(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node and sketch_0 ..: the parity of how many of a set's signatures fall on each of ``SKETCH`` bits.

    Two sets' sketches differ in no more bits than the sets differ in signatures.
    """
    bit = F.pmod(F.xxhash64("signature"), F.lit(SKETCH))
    each = sets.join(nodes, "node", "left_semi").select("node", F.explode("own.signature").alias("signature")).select("node", (bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
    return each.groupBy("node").agg(*[F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"sketch_{k}") for k in range(SKETCH // 64)])


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("signature", "band", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c not in ("signature", "band")])


def _may_link(percent: int) -> Column:
    """Whether a pair of rows may link, by the signatures that no other set has and by the sketches of the rest."""
    apart = sum((F.bit_count(F.col(f"sketch_{k}_a").bitwiseXOR(F.col(f"sketch_{k}_b"))) for k in range(SKETCH // 64)), F.lit(0))
    shared = F.floor((F.col("common_a") + F.col("common_b") - apart) / 2)
    return _enough(F.least("common_a", "common_b", shared), F.col("n_a"), F.col("n_b"), percent)


def ngram_jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id for every row: the smallest doc_id reachable by links, its own included.

    Two documents link when 100 * shared >= ``percent`` * united shingles. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased. A document of fewer than ``size`` words has one shingle, all its words; one without words or with a
    null text has none and links with nothing (its component is its own doc_id). Equal sets are one node, whatever
    their number. Rows that repeat a doc_id are documents of their own with that id; a null doc_id is ignored as a
    component's smallest, and stands only where all ids of a component are null. An empty table gives no rows. Other
    columns are not read.

    Shingles are compared by 64-bit hashes. Nodes are 64-bit fingerprints of the sets; where two sets have one, a
    second fingerprint of 64 bits keeps their rows apart.
    """
    return row_components(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def _links(source: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of all sets that link with another; a table."""
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _signatures(source, size, parts).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    groups = written(_groups(packed), "groups")
    sets = written(_open_sets(groups, percent), "open-sets")
    removed(groups)
    rows = written(_allotted(sets, percent), "allotted")
    central = F.max(F.struct("weight", "n", "node", "common", "place")).alias("lead")
    leads = rows.groupBy("signature", "band").agg(central, F.count("*").alias("members"), F.min("own_band").alias("lowest"))
    # where all sets are of the band above, they meet there
    leads = leads.where("members > 1 and lowest = band").drop("members", "lowest")
    shared = written(rows.drop("weight").join(leads, ["signature", "band"]), "shared")
    removed(rows)
    star = shared.where("node <> lead.node").select(*[F.col(f"lead.{c}").alias(f"{c}_a") for c in ("n", "common", "place")], *[F.col(c).alias(f"{c}_b") for c in ("n", "common", "place")], F.col("lead.node").alias("a"), F.col("node").alias("b"))
    pairs = written(_distinct_pairs(star.where(_enough(F.least("common_a", "common_b"), F.col("n_a"), F.col("n_b"), percent)), percent), "pairs")
    links = written(_verified(pairs, sets, percent), "links")
    found = connected_components(links)
    enough_for = F.floor(F.col("common") * (100 + percent) / percent) - F.col("n")
    known = shared.drop("lead").withColumn("enough_for", enough_for)
    for round_ in range(STAR_ROUNDS + 1):
        placed = known.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = written(_several(placed), "apart")
        if apart.isEmpty():
            break
        if not round_:
            sketches = written(_sketched(apart.select("node").distinct(), sets), "sketches")
        known = apart.drop("component")
        sketched = apart.drop("enough_for").join(sketches, "node")
        others = sketched
        if round_ < STAR_ROUNDS:
            # a leader for each signature, another one in each round
            lead = F.min_by(F.struct(*[c for c in sketched.columns if c not in ("signature", "band")]), F.xxhash64(F.lit(round_), "node")).alias("lead")
            others = sketched.groupBy("signature", "band").agg(lead).select("signature", "band", "lead.*")
        met = _side(sketched, "a").join(_side(others, "b"), ["signature", "band"]).where("component_a <> component_b and band = least(own_band_a, own_band_b)")
        met = met.where("node_a < node_b") if round_ == STAR_ROUNDS else met
        fresh = written(_distinct_pairs(met.where(_may_link(percent)).withColumnsRenamed({"node_a": "a", "node_b": "b"}), percent), "more-pairs")
        more = written(_verified(fresh, sets, percent), "links")
        if not more.isEmpty():
            # the components so far stand for the links that made them
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return found


def row_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``ngram_jaccard_components`` with text_hash (xxhash64 of the text) and component, a number of the component.

    The number is never null for a row with shingles, whatever the ids are, and null for one without.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = written(_nodes(source, size), "nodes")
    found = _links(source, size, percent)
    sets = nodes.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"))
    # of sets with one fingerprint, the links are one's
    first = sets.groupBy("node").agg(F.min("check").alias("check")).join(found, "node")
    placed = sets.join(first, ["node", "check"], "left").withColumn("component", F.coalesce("component", F.xxhash64("node", "check")))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = written(placed.join(least, "component").select("node", "check", "component", "component_id"), "placed")
    linked = nodes.where("n_shingles > 0").join(known, ["node", "check"]).select("doc_id", "text_hash", "n_shingles", "component", "component_id")
    alone = nodes.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
