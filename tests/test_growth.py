"""What a job moves grows with its texts, not with distinct words, cells or joins between them."""

from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import glossary, job, units


def _exchanged(df) -> int:
    """Exchanges of a plan but those that send a table to all tasks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "Broadcast" not in line for line in plan.split("== Initial Plan ==")[-1].splitlines())


def test_compounds_meet_terms_without_a_table_of_words(spark, monkeypatch):
    units = spark.createDataFrame([(1, n, f"w{n}ing x{n}tion-y the end") for n in range(20)] + [(2, 0, "der Anlagenfreigabe (-)"), (None, 0, None)], "doc_id long, unit_idx int, text string")
    terms = spark.createDataFrame([(2, "ing"), (3, "tion"), (4, "freigabe"), (5, " (-)"), (6, "the end")], "row int, source string")
    # more distinct words than forms, as in a large corpus
    monkeypatch.setattr(glossary, "BROADCAST_TERMS", 36)
    found = glossary.match_terms(units, terms, compound=True)
    assert _exchanged(found) == 1
    got = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(glossary, "BROADCAST_TERMS", 1)
    assert got == sorted(tuple(r) for r in glossary.match_terms(units, terms, compound=True).collect())
    assert got == sorted([(1, n, row, 1) for n in range(20) for row in (2, 3, 6)] + [(2, 0, 4, 1), (2, 0, 5, 1)])


BLOCKS = "doc_id long, block_idx int, kind string, text string, rows array<array<string>>, translate boolean"


def test_units_are_planned_and_put_back_without_joins_of_cells(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "paragraph", "One two. Three four. Five", [], True), (1, 1, "table", "", [["a", "b"], ["7", "c d. e f"]], True), (1, 2, "paragraph", "code", [], False), (2, 0, "table", "", [], True), (None, 0, "paragraph", "x", [], True)],
        BLOCKS,
    )
    planned = units.planned(blocks, 10)
    assert _exchanged(planned) == 1
    got = sorted((tuple(r) for r in planned.select("doc_id", "unit_idx", "block_idx", "cell", "piece", "text").collect()), key=str)
    assert got == sorted([(1, 0, 0, 0, 0, "One two."), (1, 1, 0, 0, 1, "Three four."), (1, 2, 0, 0, 2, "Five"), (1, 3, 1, 0, 0, "a"), (1, 4, 1, 1, 0, "b"), (1, 5, 1, 3, 0, "c d. e f"), (None, 0, 0, 0, 0, "x")], key=str)
    outputs = planned.withColumn("failed", F.col("unit_idx") == 4).withColumn("output", F.upper("text"))
    back = job.translated_blocks(blocks, outputs)
    # the plan's one, and one for each side of the join by block
    assert _exchanged(back) == 3
    shown = {(r.doc_id, r.block_idx): (r.text, r.rows) for r in back.collect()}
    assert shown == {(1, 0): ("ONE TWO. THREE FOUR. FIVE", []), (1, 1): ("", [["A", "b"], ["7", "C D. E F"]]), (1, 2): ("code", []), (2, 0): ("", []), (None, 0): ("X", [])}


def test_protected_spans_of_long_words(spark):
    import time

    texts = ["5 mm-foo@x.de, a.b@c.de", "x" * 200_000 + " @", "plain", "see https://a.de/b@c. or {x}`y`z@w.org", "٣ kg", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    begun = time.time()
    got = [(tuple(r.spans) if r.spans is not None else None, r.masked) for r in rows.select(fn.protected(F.col("text"))[1].alias("spans"), fn.protected(F.col("text"))[0].alias("masked")).collect()]
    assert time.time() - begun < 15
    assert [g[0] for g in got] == [("5 mm", "-foo@x.de", "a.b@c.de"), (), (), ("https://a.de/b@c", "{x}", "`y`", "z@w.org"), ("٣ kg",), None]
    assert [g[1] for g in got] == ["⟦P1⟧⟦P2⟧, ⟦P3⟧", texts[1], "plain", "see ⟦P1⟧. or ⟦P2⟧⟦P3⟧⟦P4⟧", "⟦P1⟧", None]


def test_segments_read_their_units_once(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a" * 6), (1, 1, 1, "b" * 4), (1, 2, 2, "c"), (2, 0, 0, "d" * 20), (None, 0, 0, "e")], "doc_id long, unit_idx int, block_idx int, text string")
    packed = units.segments(rows, 10)
    assert packed.columns == ["doc_id", "unit_idx", "block_idx", "text", "segment"]
    assert _exchanged(packed) == 1
    assert sorted((tuple(r) for r in packed.collect()), key=str) == sorted([(1, 0, 0, "a" * 6, 0), (1, 1, 1, "b" * 4, 0), (1, 2, 2, "c", 1), (2, 0, 0, "d" * 20, 0), (None, 0, 0, "e", 0)], key=str)


def test_blocks_leave_a_worker_in_small_batches(monkeypatch):
    import pyarrow as pa

    from termweave.sources import markdown

    monkeypatch.setattr(markdown, "_HELD", 10)
    taken = []

    def rows():
        for n in range(5):
            taken.append(n)
            yield 6, {"doc_id": n, "md": "x" * 6}

    batches = markdown._gathered(rows(), pa.schema([("doc_id", pa.int64()), ("md", pa.string())]))
    assert next(batches).num_rows == 2 and taken == [0, 1]
    assert [b.num_rows for b in batches] == [2, 1]


def test_files_are_read_once_by_type(spark, tmp_path):
    from termweave.sources import files

    (tmp_path / "a.md").write_text("# t\n\ntext\n")
    (tmp_path / "b.txt").write_text("x\n\ny\n")
    (tmp_path / "c.txt").write_text("\n")
    (tmp_path / "d.json").write_text("{}")
    read = files.read_files(spark, str(tmp_path))
    plan = read._jdf.queryExecution().executedPlan().toString()
    # one scan for each type and one that lists the others; nothing is joined or grouped
    assert plan.count("FileScan binaryFile") == 3 and _exchanged(read) == 0
    assert sorted((r.path.rsplit("/", 1)[1], r.block_idx, r.text) for r in read.collect() if r.error is None) == [("a.md", 0, "t"), ("a.md", 1, "text"), ("b.txt", 0, "x"), ("b.txt", 1, "y")]
    assert sorted(r.error for r in read.collect() if r.error) == ["file type '.json' is not supported", "the file has no text"]


def test_outputs_are_scored_in_their_rows(spark, monkeypatch):
    from termweave.operators import language, translation

    english, german = "the cat sat on the mat and the dog ran to the house", "der hund lief in das haus und die katze sass auf der matte"
    counts = language.gram_counts(spark.createDataFrame([(english * 3, "en"), (german * 3, "de")], "text string, lang string")).cache()
    rows = [(1, 0, english, german), (1, 1, english, english), (1, 2, english, f"{german * 3}.\n{english}"), (1, 3, "short", "other"), (1, 4, english, None), (2, 0, german, ""), (2, 1, english, f" {english}\n"), (2, 2, None, english)]
    outputs = spark.createDataFrame(rows, "doc_id long, unit_idx int, text string, output string")
    scored = translation.scores(outputs, counts, "en", "de")
    assert _exchanged(scored) == 0
    got = sorted((r.doc_id, r.unit_idx, r.score) for r in scored.collect())
    assert got == [(1, 0, 0), (1, 1, 2), (1, 2, 1), (1, 3, 0), (1, 4, 2), (2, 0, 0), (2, 1, 2), (2, 2, 1)]
    monkeypatch.setattr(language, "SENT_GRAMS", 1)
    assert got == sorted((r.doc_id, r.unit_idx, r.score) for r in translation.scores(outputs, counts, "en", "de").collect())


def test_texts_are_cut_as_they_come(monkeypatch):
    from termweave.operators import language

    monkeypatch.setattr(language, "_CHUNK", 10)
    taken = []

    def texts():
        for n in range(4):
            taken.append(n)
            yield "abcdef"

    chunks = language._chunks(texts())
    assert len(next(chunks)[0]) == 8 and taken == [0, 1]
    assert [sorted(set(owner.tolist())) for _, owner in chunks] == [[2, 3]]


def test_texts_of_trusted_documents_move_once_at_any_size(spark):
    from termweave.llm import quality_rules

    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (None, "d")], "doc_id long, text string")
    weights = quality_rules.ratio_weights(docs, docs.where("doc_id = 1").select("doc_id"))
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin [_key" not in plan
    # texts are cut once for both counts; the totals' branch is the same exchange
    assert plan.count("Generate explode(_grams") == 2


def test_answers_are_parted_in_their_rows(spark):
    from termweave.operators import translation

    raws = ["lead\n[[1]] a\n[[2]] b", "[[1]] a\n[[1]]  x \n[[2]] b\nc", "[[1]] a", "[[2]] b\n[[1]] a", "", None, "[[01]] a\n[[x]]\n[[2]]b", "[[1]] a\n[[2]] b\n[[1]] c"]
    segments = spark.createDataFrame([(n, 0, 2, [], [0, 0]) for n in range(len(raws))], "doc_id long, segment int, n_units long, spans array<string>, of_line array<int>")
    answers = spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string").withColumn("segment", F.lit(0))
    read = translation.decoded(segments, answers)
    # one for each side of the join
    assert _exchanged(read) == 2 and "Window" not in read._jdf.queryExecution().executedPlan().toString()
    assert [r.texts for r in read.orderBy("doc_id").collect()] == [["a", "b"], ["x", "b\nc"], None, None, None, None, ["a\n[[x]]", "b"], None]
