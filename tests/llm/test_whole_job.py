"""Cases in which an operator once did less than its whole job."""

import hashlib
import math
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import numpy as np

import corpus_pipeline
from termweave.llm import mixing, ngram_join, pii, quality_rules, queries, substring_dedup, suffix_dedup, token_output, tokens

TABLES = "/root/testdata/sf0.001"


def test_mix_counts_copies_in_training_order(spark, monkeypatch):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{TABLES}/documents.parquet'")
    expected = con.execute(queries.ORACLES["op4_curriculum_mix"]).fetchall()
    taken = {r[0]: (r[1], r[2], r[3], r[4]) for r in expected}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    slope = {s: mixing.SLOPES[i % 3] for i, s in enumerate(sorted(set(source.values())))}

    got = {}
    for r in queries.QUERIES["op4_training_order"](spark, TABLES).collect():
        assert r.source == source[r.doc_id]
        got.setdefault(r.doc_id, []).append(r.position)
    start = dict.fromkeys(slope, 0)
    for i in sorted(taken, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        size, whole, target, words = taken[i]
        assert len(got.get(i, [])) * size == words
        for k, t in enumerate(sorted(got.get(i, []))):
            s = slope[source[i]]
            assert math.isclose((1 - s) * t + s * t * t, min(1, (start[source[i]] + k * whole) / target), abs_tol=1e-9)
        start[source[i]] += size

    # the registered query counts the range-sorted copies: without some of them its result changes
    in_order = mixing.in_training_order
    assert sorted(map(tuple, queries.op4_curriculum_mix(spark, TABLES).collect())) == sorted(expected)
    monkeypatch.setattr(mixing, "in_training_order", lambda mixed, columns: in_order(mixed, columns).where("position < 0.5"))
    assert 0 < sum(r.taken for r in queries.op4_curriculum_mix(spark, TABLES).collect()) < sum(r[4] for r in expected)


def test_quality_target_counts_all_trusted_documents(spark):
    # more than 20,000 of them; as they are the corpus, no n-gram is likelier in one than in the other
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 7), F.lit("and"), F.concat(F.lit("v"), F.col("id") % 11)).alias("text"))
    weights = [r.weight for r in quality_rules.ratio_weights(docs, docs.select("doc_id")).collect()]
    assert len(weights) > 18 and max(map(abs, weights)) < 1e-9

    # ids and texts that are null or repeat, and trusted ids without a document, against plain counts
    rows = [(1, "a b a"), (1, "c"), (2, "a c"), (None, "a d"), (3, None), (4, "")]
    trusted = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    got = {r.bucket: r.weight for r in quality_rules.ratio_weights(spark.createDataFrame(rows, "doc_id long, text string"), trusted).collect()}
    raw, target = Counter(w for _, t in rows for w in (t or "").split()), Counter("abac")
    words = spark.createDataFrame([(w,) for w in raw], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(quality_rules.BUCKETS)).alias("bucket")).collect()
    for r in words:
        share = raw[r.w] / raw.total()
        expected = math.log((target[r.w] + quality_rules.PRIOR * share) / (target.total() + quality_rules.PRIOR) / share)
        assert math.isclose(got[r.bucket], expected, abs_tol=1e-12)


def chain(seed):
    """Three texts of 200 words: neighbours differ in three words and link, the ends do not."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [words]
    for at in (20, 120):
        words = list(words)
        for k in range(5):
            words[at + 12 * k % 80] = f"x{at}{k}"
        texts.append(words)
    return [" ".join(t) for t in texts]


def test_join_links_rows_without_id(spark):
    a, b, c = chain(1)
    d, e, f = chain(2)
    rows = [(1, a), (None, b), (None, b), (7, c), (None, d), (None, e), (None, f), (None, None), (None, ""), (9, f"{chain(3)[0]}")]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in (a, b, c))]
    link = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert link(sets[0], sets[1]) and link(sets[1], sets[2]) and not link(sets[0], sets[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.ngram_jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 196, 1), (None, 196, 1), (None, 196, 1), (7, 196, 1), *[(None, 196, None)] * 3, (None, 0, None), (None, 0, None), (9, 196, 9)], key=str)
    groups = {}
    for r in ngram_join.row_components(docs).where("n_shingles > 0").collect():
        groups[r.component] = groups.get(r.component, 0) + 1
    assert sorted(groups.values()) == [1, 3, 4]


def test_join_counts_hot_signatures_by_parts(spark):
    # a passage of 36 shingles that many sets share: its count meets parts of the sets, not each set
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    found = {}
    for sets in (600, 1200):
        rows = [(i, " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(60)])) for i in range(sets)]
        rows += [(10_000 + i, f"{t} more") for i, t in rows[:50]]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        packed = ngram_join._signatures(docs, 5, 4).repartitionById(4, "bucket").sortWithinPartitions("bucket")
        groups = ngram_join._groups(packed).cache()
        counted = ngram_join._counted(groups).select("signature", "members", F.size("sets").alias("size")).collect()
        assert {(r.signature, r.members) for r in counted} == {(s, sets + 50) for s in {r.signature for r in counted}}
        assert len({r.signature for r in counted}) == 36 and sum(r.size for r in counted) == 36 * (sets + 50)
        assert len(counted) <= 36 * ((sets + 50) / ngram_join.PART + 4)
        whole = ngram_join._open_sets(groups, 75).collect()
        assert sorted(r.common for r in whole) == [96] * 100
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(docs).collect()}
        assert got == {i: i % 10_000 for i, _ in rows}
        found[sets] = len(counted)
    assert found[1200] <= 2 * found[600]


def test_join_lists_hot_signatures_by_set(spark):
    # a passage that is hot in two gatherings of three; 140 sets are gathered by both, 20 by the third too
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(8)]) for _ in range(400)]
    texts += [f"{t} more" for t in texts[:30]]
    dealt = [texts[:300], texts[160:300] + texts[400:], texts[:20] + texts[300:400]]
    docs = spark.createDataFrame([(k, t) for k, own in enumerate(dealt) for t in own], "part int, text string").repartitionById(3, "part")
    packed = ngram_join._signatures(docs, 5, 4).repartitionById(4, "bucket").sortWithinPartitions("bucket")
    groups = ngram_join._groups(packed).cache()
    sets = {ngram_join._fingerprint(s): set(s.tolist()) for s in ngram_join.shingle_sets([t.encode() for t in texts], 5)}
    held = Counter(x for s in sets.values() for x in s)
    opened = ngram_join._open_sets(groups, 75)
    # a set has its hot signatures as one list, a row for each of them is never made
    assert "Generate" not in opened._jdf.queryExecution().executedPlan().toString()
    got = {r.node: r for r in opened.collect()}
    shared = {node: sum(held[x] > 1 for x in s) for node, s in sets.items()}
    assert {node: r.common for node, r in got.items()} == {node: k for node, k in shared.items() if 100 * k >= 75 * len(sets[node])}
    members = {}
    for node, r in got.items():
        own = [(x.members, x.signature) for x in r.own]
        assert own == sorted(set(own)) and r.n == len(sets[node]) and len({x for _, x in own}) == len(own) == r.common
        assert math.isclose(r.weight, sum(math.log2(k) for k, _ in own) / r.n)
        for k, x in own:
            assert members.setdefault(x, k) == k
    # in the own bucket a set counts once, in each gathering where the signature is hot once more
    assert Counter(members.values())[300 + 170 + 120] == 36
    assert ngram_join._hot_lists(groups).count() == 300 + 170


def test_surrogates_stand_in_the_plan_once(spark):
    # the plan had 178,000 characters, each value written out wherever it was used
    docs = spark.createDataFrame([(1, "Frau Müller-Lüdenscheid, call +49 30 1234 5678 or Müller", "de")], "doc_id long, text string, lang string")
    replaced = pii.replace_pii(docs, "k")
    assert len(replaced._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    drawn = spark.range(1).select(pii.surrogate(F.lit("card"), F.concat(F.lit("4111111111111111"), F.lit("")), F.col("id").cast("int"), "k").alias("s"))
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("sha2(") <= 16


def test_near_duplicates_decide_by_row(spark):
    a, near, _ = chain(1)
    d, e, f = chain(2)
    b, g = chain(3)[0], chain(4)[0]
    rows = [(5, a), (5, b), (6, near), (7, g), (7, g), (None, d), (None, e), (None, f), (None, f), (8, ""), (8, None), (None, "single words"), (9, "single words"), (4, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, TABLES).collect()), key=str)
    unnamed = [r for r in got if r[0] is None]
    assert len(unnamed) == 1 and unnamed[0][1] in (d, e, f)
    assert [r for r in got if r[0] is not None] == sorted([(5, a), (4, b + " more"), (7, g), (8, ""), (8, None), (9, "single words")], key=str)
    other = spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, other, TABLES).count() == 2


def test_encoder_follows_the_library():
    encode = tokens.Encoder(tokens.default_vocabulary())
    rng = random.Random(1)
    alphabet = [*"abcXYZ İıÀéßΣσςЖж你好{}<>'’`~#1234567890_-.,|\u0307\u0301\n\t\x1c\x85\xa0", "<|endoftext|>", "don't", "ﬁ", "ǅ"]
    texts = ["İ{", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)), "ab" * 400]
    for _ in range(2):
        ids, sizes = encode([t.encode() for t in texts], None)
        for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_hold_their_counts():
    ids, counts = np.arange(2000, dtype=np.uint32), np.array([1500, 1, 499])
    back = token_output.decode_file(token_output.encode_file(ids, counts))
    assert np.array_equal(back[0], ids) and np.array_equal(back[1], counts)


def test_repeated_id_with_another_text_keeps_it(spark):
    def words(seed):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))

    a, b = words(1), words(2)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # a row without an id comes first; equal rows are one document
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()), key=str)
    assert got == sorted([(None, 0), (1, 0), (2, 100), (2, 0), (2, 0), (3, 100)], key=str)
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_bytes(docs).collect()), key=str)
    assert got == sorted([(None, 0), (1, 0), (2, len(a)), (2, 0), (2, 0), (3, len(b))], key=str)


def test_names_without_title(spark):
    texts = [
        "Mr. John Smith met us. John Smith left. Smith too. Smithson stays.",
        "Dr. Jane Doe and Prof. Kim wrote. Dear Alice Johnson, call 988 555 2485. Dear Sir, hello.",
        "Frau Müller und Herr Müller; Frau Anna Müller-Lüdenscheid.",
        "Κύριος Νίκος Παππάς",
    ]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _book string, hash int")
    out = pii.replace_pii(docs, "k").orderBy("doc_id").collect()
    got = [r.text for r in out]
    assert all((r._book, r.hash) == ("x", 5) for r in out)
    one = got[0].replace(".", "").split()
    assert one[1:3] == one[5:7] and one[2] == one[8] and got[0].endswith("Smithson stays.") and "Smith " not in got[0] and "John" not in got[0]
    assert not any(w in got[1] for w in ("Jane", "Doe", "Kim", "Alice", "Johnson", "988", "2485")) and "Dear Sir, hello" in got[1]
    two = got[2].replace(";", "").replace(".", "").split()
    assert two[1] == two[4] == two[7].split("-")[0] != "Müller" and len(two[7].split("-")) == 2
    assert all("Ͱ" <= c <= "Ͽ" for c in got[3].replace(" ", "").lower())


def test_rows_whose_hashes_share_31_bits_lose_nothing(spark):
    """Without ids rows are told apart by their texts: two whose hashes agree in 31 bits, one of them repeated by others."""
    from pyspark.sql import functions as F

    from termweave.llm import substring_dedup, suffix_dedup

    texts = spark.range(150_000).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), F.hex(F.xxhash64("id", i)))), " ").alias("text"))
    meet = texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()
    assert meet, "two of so many texts meet"
    a, b = meet["t"][:2]
    docs = spark.createDataFrame([(None, a), (None, b), *[(None, f"{a} t{i} a tail that is its own") for i in range(10)], (1, a), (2, b)], "doc_id long, text string")
    words = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()]
    # of the two texts, however often they come, one copy stays, and all tails
    assert sum(n - gone for _, n, gone in words) == 40 + 40 + 10 * 7
    kept = sum(r.n_bytes - r.n_removed for r in suffix_dedup.dedup_bytes(docs).collect())
    assert kept >= len(a) + len(b)
