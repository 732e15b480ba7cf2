"""Edge cases of the operators, and brute force where SQL can't express them."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from termweave.llm import mixing, ngram_join, packing, pii, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_output, tokens, topk
from termweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, label int, size long"


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows():
    a, b = sentence(1, 300), sentence(2, 120)
    near = a.split()
    near[100] = "changed"
    return [
        (1, a, "en", "s1", 1, "x", 1, 9),
        (2, " ".join(near), "en", "s1", 1, "x", 1, 9),
        (3, a, None, None, None, None, None, None),
        (4, None, "en", "s2", 1, "x", 1, 9),
        (5, "", "en", "s2", 1, "x", 1, 9),
        (6, b + "\n" + b, "en", "s2", 1, "x", 1, 9),
        (7, "three small words", "en", "s3", 1, "x", 1, 9),
        (8, "Three SMALL words", "en", "s3", 1, "x", 1, 9),
        (9, sentence(9, 20_000), "de", "s3", 1, "x", 1, 9),
        (10, "mail a.b@c.org and <|endoftext|> don't ÄÖ ΑΣ \x1c x", "en", "s1", 1, "x", 1, 9),
        (11, b, "en", "s1", 1, "x", 1, 9),
        (11, b, "en", "s1", 1, "x", 1, 9),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in rows()}


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(20)]
    vectors += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, []), (600, [2.0, 3.0]), (650, [1.0, 1.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(256 * x) for x in np.array(v, np.float32).astype(float)] for i, v in vectors if v and None not in v and not any(map(math.isnan, v))}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_trees_stand_while_queries_pass(spark, monkeypatch):
    """No tree is repeated for blocks of queries, whatever their number; the results are those of one shard and block."""
    rng = np.random.default_rng(6)
    rows = [(i % 900, [float(x) for x in rng.normal(size=3 + i % 2)]) for i in range(1000)] + [(1000 + i, [0.25] * 4) for i in range(50)] + [(2000, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, topk.top_k(vectors, every=5).collect()))
    for name, value in (("BLOCK_QUERIES", 7), ("LEAF_ROWS", 4), ("SHARDS", 9), ("LEAST_ROWS", 1), ("MOST_ROWS", 200)):
        monkeypatch.setattr(topk, name, value, raising=False)
    found = topk.top_k(vectors, every=5)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not [line for line in plan if ("Generate" in line or "Join" in line) and "tree#" in line]
    assert sorted(map(tuple, found.collect())) == whole and len(whole) > 800


def test_substring_dedup(docs, empty):
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    seen = set()
    for i, text in sorted(texts().items()):
        words = text.split(" ") if i == 10 else text.split()
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            gone |= set(range(k, k + 20)) if w in seen else set()
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(words), len(gone), " ".join(kept)), i
        assert all(f.words >= 20 for f in got[i].factors)
    assert got[3].n_removed == 300 and got[3].factors[0].ref_doc == 1
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: r for r in suffix_dedup.dedup_bytes(docs).collect()}
    seen = set()
    for i, text in sorted(texts().items()):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(raw), int(gone.sum()), kept), i
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_mixing(docs, empty):
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    got = mixed.collect()
    assert len(got) == len(rows()) and all(r.taken <= 2 * r["size"] for r in got)
    everything = sum(r["size"] for r in got)
    targets = {r.source: r.target for r in got}
    assert math.isclose(sum(targets.values()), 1.5 * everything)
    for source, target in targets.items():
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
    ordered = mixing.in_training_order(mixed, ["doc_id"]).collect()
    assert len(ordered) == sum(r.copies for r in got) and all(0 <= r.position <= 1 for r in ordered)
    assert mixing.mix(empty.select("doc_id", "text", "source")).count() == 0


def test_quality_rules(spark, docs, empty):
    trusted = spark.createDataFrame([(1,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules.quality(docs, trusted).collect()}
    for i, text in texts().items():
        if i == 10:
            continue
        words = text.split()
        threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(threes)
        again = {q for k, t in enumerate(threes) if count[t] > 1 for q in (k, k + 1, k + 2)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(words), sum(map(len, words)), len(again)), i
    assert got[6].n_dup_lines == 1 and got[4].base_failed and not got[4].kept and got[6].base_failed
    assert quality_rules.quality(empty, trusted).count() == 0


def test_pii(spark, docs, empty):
    data = [
        (1, "A.Lee@mail.org a.lee@mail.org 42.144.35.254 4111 1111 1111 1111 / 4111111111111111 +1 (988) 555-2485"),
        (2, "a.lee@mail.org b.lee@mail.org Mr. John Smith, Mrs. Smith; Mr. Smith 4111111111111111"),
        (3, None),
        (None, "password=abc123def"),
    ]
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string"), "k").collect()}
    one, two = got[1].split(), got[2].split()
    assert one[0].lower() == one[1] == two[0] != two[1] and one[0][0].isupper() and "lee" not in got[1] + got[2]
    assert "".join(one[3:7]) == one[8] == two[-1] and len(one[8]) == 16 and "4111" not in got[1]
    assert two[4].strip(",") == two[6].strip(";") == two[8] and "Smith" not in got[2]
    assert got[3] is None and got[None].startswith("password=") and "abc123def" not in got[None]
    assert pii.replace_pii(docs, "k").where("doc_id in (1, 9)").select("text").join(docs.select("text"), "text", "left_semi").count() == 2
    assert pii.replace_pii(empty, "k").count() == 0


def test_surrogates_stay_distinct(spark):
    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(300)] + [("card", str(i)) for i in range(10)], "type string, norm string")
    got = pii.surrogates(entities, "k").collect()
    assert len({(r.type, r.surrogate) for r in got}) == 310
    assert not {(r.type, r.surrogate) for r in got} & {(r.type, r.norm) for r in got}


def test_shards_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.empty(0, np.uint32), np.array([7]), rng.integers(0, 50_000, 5000), rng.integers(0, 2**32, 1500), np.r_[np.full(600, 9), 2**31]):
        raw = token_output.encode_shard(ids)
        assert np.array_equal(token_output.decode_shard(raw), ids)
        assert np.array_equal(token_output.decode_shard(raw, 1, 1), ids[512:1024])


def test_token_files_and_packing(docs, empty):
    vocabulary = tokens.default_vocabulary()
    encode = tokens.Encoder(vocabulary).tokenizer.encode
    ids = {i: np.array([*encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts().items()}
    start, expected = 0, []
    for i in sorted(r[0] for r in rows()):
        expected.append((i, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    written = token_output.write_token_files(docs, vocabulary, shard_ids=500)
    assert sorted(map(tuple, token_output.read_token_files(written).collect())) == expected
    assert token_output.read_token_files(token_output.write_token_files(empty, vocabulary)).count() == 0

    packed = packing.pack_documents(docs, vocabulary).toPandas()
    for r in packed.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 4096 and (own["offset"].to_numpy() == np.r_[0, own["length"].cumsum()[:-1]]).all()
    assert packed["length"].sum() == start
    assert packing.pack_documents(empty, vocabulary).count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 9, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]


def test_classifier(spark, empty):
    data = [(i, sentence(i, 60) if i % 3 else " ".join(w.upper() + "!!" for w in sentence(i, 60).split())) for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, label int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 202 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.9
    assert quality_classifier.classify(empty, labels).count() == 0


def test_join(docs, empty):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(docs).collect())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for i, w in ((i, t.lower().split()) for i, t in texts().items())}
    component = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                low = min(component[a], component[b])
                component = {i: low if c in (component[a], component[b]) else c for i, c in component.items()}
    assert {(i, c) for i, _, c in got} == set(component.items()) and len(got) == len(rows())
    assert {i: n for i, n, _ in got}[7] == 1 and {i: n for i, n, _ in got}[4] == 0
    assert ngram_join.ngram_jaccard_components(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {i: 10 for i in range(10, 41)} | {60: 60, 61: 60}


def test_components_follow_union_find(spark):
    import random

    draw = random.Random(5)
    path = [(n, n + 1) for n in range(0, 40)]
    pairs = [(draw.randrange(100, 190), draw.randrange(100, 190)) for _ in range(70)] + [(300, n) for n in range(301, 330)] + path[::-1] + path[:9]
    parent = {n: n for pair in pairs for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    first = connected_components(spark.createDataFrame(pairs[:80], "a bigint, b bigint"))
    again = first.selectExpr("node AS a", "component AS b").unionByName(spark.createDataFrame(pairs[80:], "a bigint, b bigint"))
    for links in (spark.createDataFrame(pairs, "a bigint, b bigint"), again):
        assert sorted(map(tuple, connected_components(links).collect())) == sorted((n, root(n)) for n in linked)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
