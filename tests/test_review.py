"""Scores of outputs and the rounds that ask again, on a fixed model."""

from pyspark.sql import functions as F

from termweave.operators import translation

DE = "Die Prüfung der Anlage wird jährlich von der Behörde durchgeführt."
EN = "The inspection of the plant is carried out every year by the authority."
ROWS = [
    (1, 0, 0, DE, EN),  # clean
    (1, 1, 1, DE, DE),  # echo, mended by a strict call
    (1, 2, 2, DE, EN + " " + DE + " " + EN),  # some sentences left, mended
    (1, 3, 3, DE, None),  # nothing, and nothing again
    (1, 4, 4, DE + " Nein.", EN + " " + DE),  # some left, the new answer no better
    (2, 0, 0, "Nein", "Nein"),  # short texts count as clean
]


def test_review(spark):
    counts = spark.createDataFrame([(lang, text[i : i + 3]) for lang, text in (("de", DE.lower()), ("en", EN.lower())) for i in range(len(text) - 2)], "lang string, gram string").groupBy("lang", "gram").count().withColumnRenamed("count", "n")
    outputs = spark.createDataFrame([(*r, 1, r[4] is None) for r in ROWS], "doc_id bigint, unit_idx int, block_idx int, text string, output string, calls int, failed boolean")
    scored = {(r.doc_id, r.unit_idx): r.score for r in translation.scores(outputs, counts, "de", "en").collect()}
    assert scored == {(1, 0): 0, (1, 1): 2, (1, 2): 1, (1, 3): 2, (1, 4): 1, (2, 0): 0}
    model = lambda text, strict: F.when(F.col("unit_idx").isin(1, 2), EN).when(F.col("unit_idx") == 4, DE)
    review = translation.reviewed(outputs, model, counts, "de", "en")
    got = {(r.doc_id, r.unit_idx): (r.output, r.calls, r.failed, r.score) for r in review.collect()}
    assert got == {(1, 0): (EN, 1, False, 0), (1, 1): (EN, 2, False, 0), (1, 2): (EN, 2, False, 0), (1, 3): (None, 3, True, 2), (1, 4): (ROWS[4][4], 3, False, 1), (2, 0): ("Nein", 1, False, 0)}
    assert [tuple(r) for r in translation.mixed_blocks(review).collect()] == [(1, 4)]
    same = translation.scores(outputs, counts, "de", "de").where("doc_id = 1").orderBy("unit_idx")
    assert [r.score for r in same.collect()] == [0, 2, 0, 2, 0]
