"""Line dedup, ranked search and importance resampling against brute force, on awkward rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from termweave.llm import importance, impact_index, line_dedup

SCHEMA = "doc_id long, text string, hash string, row string, terms int, n long, score long"
WORDS = ["alpha", "Beta", "GAMMA", "delta9", "Ünï", "ÄÖ", "x", "y", "zeta", "eta"]


def texts():
    rng = random.Random(3)
    some = []
    for i in range(60):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 5))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(["  Shared LINE\t", "shared line", "other", "", "Übrig ÄÖ"]))
        some.append((i, "\n".join(lines)))
    long = "\n".join(rng.choice([*WORDS, "shared line"]) for _ in range(30_000))
    more = [(70, long), (71, None), (72, ""), (73, "shared line"), (74, "\n\n"), (75, "x\r\n shared line \x0b\n\x1cshared line"), (76, " ; , . ")]
    return some + more + [(80, "twice\ntwice\nshared line"), (80, "twice\ntwice\nshared line"), (80, "apart\nother"), (None, "no id\nother"), (None, "no id\nother"), (None, "none")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "h", "r", 1, 2, 3) for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_lines(text):
    return (text or "").split("\n")


def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize(("least", "chars", "broadcast"), [(10, 1, 50_000), (2, 1, 50_000), (10, 6, 50_000), (3, 0, 50_000), (2, 1, 2)])
def test_lines(docs, monkeypatch, least, chars, broadcast):
    """With a small limit most shared lines go by the join by hash."""
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", broadcast)
    held = Counter(k for _, text in texts() for k in {key(line) for line in as_lines(text)})
    # no key shorter than a code point is one, whatever is asked
    gone = {k for k, n in held.items() if n >= least and len(k) >= chars and (k or chars == 0)}
    expected = []
    for i, text in texts():
        stay = [line for line in as_lines(text) if key(line) not in gone]
        expected.append((i, len(as_lines(text)), len(as_lines(text)) - len(stay), "\n".join(stay)))
    got = [tuple(r) for r in line_dedup.dedup_lines(docs, least, chars).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert impact_index.search(empty, items).count() == 0
    assert impact_index.search(docs, items.limit(0)).count() == 0
    assert impact_index.search(docs.where("doc_id = 72"), items).count() == 0
    assert importance.resample(empty, items).count() == 0
    assert importance.resample(docs, items.limit(0)).count() == len(texts())


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(rows, items, k):
    lists = [(i, terms(t)) for i, t in rows]
    lists = [(i, own) for i, own in lists if own]
    n_docs, n_terms = len(lists), sum(len(own) for _, own in lists)
    df = Counter(t for _, own in lists for t in set(own))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, own in lists:
            tf, m = Counter(own), 50 + 50 * len(own) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t])
            if score:
                scores.append((-score, i is None, i))
        out += [(item, place + 1, i, -s) for place, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block", "k"), [(8192, 100_000, 50), (7, 100_000, 4), (16, 3, 5)])
def test_search(spark, docs, monkeypatch, shard, block, k):
    """Shards and blocks of any size give the same ranks."""
    monkeypatch.setattr(impact_index, "SHARD", shard)
    monkeypatch.setattr(impact_index, "BLOCK_TERMS", block)
    items = [(1, "alpha beta, beta"), (2, "ünï Ünï zeta"), (2, "eta"), (3, "nowhere"), (4, None), (5, ""), (None, "delta9 x"), (7, "x y x y shared line twice")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    if shard != 8192:  # tasks import the module anew: its sizes are set where they run
        assert sorted(([tuple(r) for r in search_locally(docs, items, shard, k)]), key=str) == ranked(texts(), items, k)
        return
    got = impact_index.search(docs, asked, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(texts(), items, k)


def search_locally(docs, items, shard, k):
    """The same steps on the driver, where the sizes of shards are the test's."""
    import pyarrow as pa

    lists = [(i, terms(t)) for i, t in texts()]
    lists = [(i, own) for i, own in lists if own]
    n_docs, n_terms = len(lists), sum(len(own) for _, own in lists)
    df = Counter(t for _, own in lists for t in set(own))
    number = {t: i for i, t in enumerate(df)}
    counted = [Counter(own) for _, own in lists]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([i for i, _ in lists], pa.int64()), "n": pa.array([len(own) for _, own in lists], pa.int64()),
        "terms": pa.array([[number[t] for t in c] for c in counted], pa.list_(pa.int32())), "tfs": pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())),
    })
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= {t for t in terms(text) if t in df}
    best = defaultdict(list)
    for ids, null, n, term, place, tf in impact_index._shards(iter([batch])):
        assert len(ids) <= shard
        m = 50 + 50 * n * n_docs // n_terms
        n_words = -(-len(ids) // 64)
        for item, own in asked.items():
            total, carry = np.zeros((2, 1, 45, n_words), np.uint64)
            for t in own:
                at = term == number[t]
                w = impact_index.weight(n_docs, df[t])
                impact = w * ((10**9 * tf[at]) // (1000 * tf[at] + 20 * m[place[at]]))
                impact_index.carry_save(total[0], carry[0], impact_index.sliced(place[at], impact, 45, n_words))
            slices = impact_index.carried(total, carry)[0]
            found = impact_index.top_places(slices, k, np.full(n_words, 2**64 - 1, np.uint64))
            best[item] += [(-int(s), bool(null[p]), int(ids[p])) for s, p in zip(impact_index.numbers_at(slices, found), found)]
    for item, rows in best.items():
        for place, (s, no_id, i) in enumerate(sorted(rows)[:k]):
            yield item, place + 1, None if no_id else i, -s


def test_slices():
    """Sums by carries and the top of them, on random numbers with many ties and zeros."""
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 500):
        n_words = -(-n // 64)
        numbers = [np.where(rng.random(n) < 0.5, 0, rng.integers(0, 1 << int(rng.integers(1, 30)), n)) for _ in range(20)]
        total, carry = np.zeros((2, 1, 40, n_words), np.uint64)
        for x in numbers:
            impact_index.carry_save(total[0], carry[0], impact_index.sliced(np.arange(n), x, 40, n_words))
        slices, sums = impact_index.carried(total, carry)[0], sum(numbers)
        assert (impact_index.numbers_at(slices, np.arange(n)) == sums).all()
        coarse = sums // (1 << 26)
        few = impact_index.sliced(np.arange(n), coarse, 40, n_words)
        everything = np.packbits(np.arange(n_words * 64) < n, bitorder="little").view(np.uint64)
        for k in (1, 5, 64, 1000):
            for values, bits in ((sums, slices), (coarse, few)):
                best = sorted((-v, i) for i, v in enumerate(values) if v)[:k]
                assert sorted(impact_index.top_places(bits, k, everything)) == sorted(i for _, i in best)


def features(text, longest):
    found = re.findall(importance.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)], len(found)


@pytest.mark.parametrize(("longest", "percent", "least", "n_buckets"), [(1, 10, 20, 10_000), (2, 50, 3, 10_000), (3, 100, 0, 7), (1, 30, 1, 50_000)])
def test_resampling(spark, docs, longest, percent, least, n_buckets):
    wanted = ["alpha beta gamma", None, "", "Zeta eta ÄÖ", "nowhere to be seen"]
    got = importance.resample(docs, spark.createDataFrame([(t, 1) for t in wanted], "text string, n_words int"), percent, least, longest, n_buckets)
    own = [(i, *features(t, longest)) for i, t in texts()]
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = Counter(bucket(f) for _, fs, _ in own for f in fs), Counter(bucket(f) for x in wanted for f in features(x, longest)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(s.total() + n_buckets) / ((s[b] + 1) * float(t.total() + n_buckets))))
    rows = []
    for i, fs, n in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = Counter((r[:4], place + 1) for place, r in enumerate(order[: percent * len(order) // 100]))
    result = [tuple(r) for r in got.collect()]
    assert Counter(r[:4] for r in result) == Counter(r[:4] for r in rows)
    assert Counter((r[:4], r[4]) for r in result if r[4] is not None) == drawn

