"""The pipeline's stages on a small table with null and repeated ids, clashing column names and no rows."""

import random

import pytest

import corpus_pipeline
from termweave.llm import tokens

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash int, _id string, position double, target string, book int"


def text(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    def row(i, t, source="s1"):
        return (i, t, "en", source, len(t or ""), "r", 1, "x", 0.5, "t", 2)

    a = text(1)
    near = a.split()
    near[60] = "changed"
    mail = text(2) + " write to bob@mail.org now"
    return [row(1, a), row(2, " ".join(near)), row(None, a), row(3, mail), row(3, text(3)), row(3, text(3)), row(None, text(4), None), row(4, None), row(5, ""), row(6, "few words", "s2"), *(row(10 + i, text(10 + i), f"s{i % 4}") for i in range(12))]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], SCHEMA), TABLES).count() == 0


def test_stages(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, TABLES)
    given = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} <= given
    assert not [r for r in kept.collect() if len((r.text or "").split()) < 50]

    one = stages["n-gram Jaccard join"](spark, docs, TABLES)
    assert one.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
    gone = {(2, rows()[1][1]), (None, rows()[0][1])}
    expected = sorted({(r[0], r[1]) for r in rows()} - gone, key=str)
    assert got == expected

    private = {(r.doc_id, r.text) for r in stages["PII"](spark, docs, TABLES).collect()}
    assert not any("bob@" in (t or "") for _, t in private) and len([1 for _, t in private if "@" in (t or "")]) == 1

    mixed = stages["mixing sources to target weights"](spark, docs, TABLES)
    copies = {}
    for r in mixed.collect():
        copies[(r.doc_id, r.text)] = copies.get((r.doc_id, r.text), 0) + 1
    given = {}
    for r in rows():
        given[r[:2]] = given.get(r[:2], 0) + 1
    assert mixed.columns == docs.columns and all(n <= 2 * given[k] for k, n in copies.items())

    encode = tokens.Encoder(tokens.default_vocabulary())
    packed = stages["best-fit packing"](spark, docs, TABLES).collect()
    assert sum(r.length for r in packed) == encode([(r[1] or "").encode() for r in rows()])[1].sum()
