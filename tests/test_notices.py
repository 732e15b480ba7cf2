"""Notices, languages of uploads and untranslated texts on small tables."""

from termweave.operators import benchmark, language, results

DE = "Die Prüfung der Anlage wird jährlich von der Behörde durchgeführt."
EN = "The inspection of the plant is carried out every year by the authority."


def counts(spark):
    return language.gram_counts(spark.createDataFrame([("de", DE), ("en", EN)], "lang string, text string"))


def test_notices(spark):
    rows = [(1, "failed", i, f"text {i:02}") for i in range(13)] + [(1, "language", 5, "b"), (1, "language", 4, "a"), (None, "failed", 0, "c")]
    got = {(r.doc_id, r.kind): (r.n, r.listed, r.more) for r in results.notices(spark.createDataFrame(rows, "doc_id long, kind string, place int, detail string")).collect()}
    assert got[1, "failed"] == (13, "\n".join(f"- text {i:02}" for i in range(10)), 3)
    assert got[1, "language"] == (2, "- a\n- b", 0) and got[None, "failed"] == (1, "- c", 0)


def test_languages_of_documents(spark):
    rows = [(1, 0, "heading", "", [], True), (1, 1, "paragraph", DE, [], True), (1, 2, "code", DE, [], False), (1, 3, "table", "", [[DE, EN], ["Wert", DE]], True), (2, 1, "paragraph", EN, [], True), (2, 0, "paragraph", "Nein", [], True), (3, 0, "page_break", "", [], True)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_idx int, kind string, text string, rows array<array<string>>, translate boolean")
    assert {r.doc_id: r.lang for r in results.inspected(blocks, counts(spark)).collect()} == {1: "de", 2: "en", 3: None}
    assert {r.doc_id: r.untranslated for r in benchmark.untranslated(blocks, counts(spark), "de").collect()} == {1: 3, 2: 0, 3: 0}


def test_models_to_run(spark):
    models = spark.createDataFrame([("A:1b",), ("b:2b",), ("a:1B",)], "tag string")
    assert sorted(r.tag for r in benchmark.to_run(models, spark.createDataFrame([("a:1b",), ("A:1B",), ("x",)], "tag string")).collect()) == ["A:1b", "a:1B"]
