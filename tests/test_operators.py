import json

from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import glossary, layout, translation, units, usage
from termweave.sources.documents import line_blocks, read_usage_log, text_paragraphs
from termweave.streaming.usage import append_events, daily_jobs, read_appended, read_usage_stream, to_files


def test_blocks_and_units(spark):
    docs = spark.createDataFrame([(1, "Title\na | 12 | c\n\nLast."), (2, None)], "doc_id long, text string")
    blocks = line_blocks(docs)
    assert [(r.block_idx, r.kind) for r in blocks.where("doc_id = 1").orderBy("block_idx").collect()] == [(0, "heading"), (1, "table"), (2, "paragraph"), (3, "paragraph")]
    assert [(r.unit_idx, r.text) for r in units.units(blocks).orderBy("unit_idx").collect()] == [(0, "Title"), (1, "a"), (2, "c"), (3, "Last.")]
    assert units.markdown(blocks).where("doc_id = 1").first().md == "# Title\n\n| a | 12 | c |\n|---|---|---|\n\n\n\nLast."


def test_paragraphs_collapse(spark):
    docs = spark.createDataFrame([(1, "a\n b\n\n \n c ")], "doc_id long, text string")
    assert [r.text for r in text_paragraphs(docs).orderBy("block_idx").collect()] == ["a b", "c"]


def test_segments_reset_and_oversized(spark):
    rows = [(1, 0, "a" * 6), (1, 1, "b" * 4), (1, 2, "c" * 30), (1, 3, "d")]
    got = units.segments(spark.createDataFrame(rows, "doc_id long, unit_idx int, text string"), 10).orderBy("unit_idx").collect()
    assert [r.segment for r in got] == [0, 0, 1, 2]


def test_protect_roundtrip(spark):
    text = "Use `x`, see https://a.b/c. Mail me@x.org {name} 5 km now, 3 Monate."
    masked, spans = fn.protected(F.lit(text))
    row = spark.range(1).select(masked.alias("m"), spans.alias("s"), fn.restored(masked, spans).alias("back")).first()
    assert row.back == text and row.s == ["`x`", "https://a.b/c", "me@x.org", "{name}", "5 km"] and "⟦P5⟧" in row.m


def test_tags(spark):
    texts = ["<b>x</b>", "<b><i>x</b></i>", "<b>x", "x</b>", "plain", "<a1><b>x</b></a1>"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.tags_balanced(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, True, True]


def test_wire(spark):
    raw = "<think>hm</think>lead\n[[1]] a\nmore\n[[1]] b\n[[2]] c\n[[1]] d"
    records = units.wire_lines(spark.createDataFrame([(7, raw)], "key long, raw string"))
    assert [(r.id, r.text) for r in units.last_per_run(records).orderBy("seq").collect()] == [(1, "b"), (2, "c"), (1, "d")]


def test_glossary(spark):
    sheet = spark.createDataFrame([(2, "Haus", "house"), (3, "HAUS", "house"), (4, "Tür", "door"), (5, "Tür", "gate"), (6, "x", None), (7, None, None)], "row int, source string, target string")
    assert [(r.row, r.issue) for r in glossary.checked(sheet).orderBy("row").collect()] == [(2, None), (3, "duplicate"), (4, "conflict"), (5, "conflict"), (6, "empty_cell")]
    texts = spark.createDataFrame([(1, 0, "Hauses und Haus, Haushalt; hausen")], "doc_id long, unit_idx int, text string")
    assert glossary.match_words(texts, sheet.limit(1)).first().n == 3


def test_usage(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"ts":"2024-01-02T09:59:00+00:00","event":"job_start","user":"a"}\n{"ts":"2024-01-02T10:00:00+00:00","event":"job_end","user":"a","duration_s":60,"status":"ok"}\n{"broken\n{"ts":"2024-01-02T11:00:00+00:00","event":"job_end","user":"a","duration_s":30,"status":"error"}\n{"ts":"2024-01-03T00:00:00+00:00","event":"login_failed","user":"x"}\n')
    events = read_usage_log(spark, str(log))
    row = usage.totals(events).collect()
    assert [(r.user, r.jobs, r.minutes, r.errors) for r in row] == [("a", 1, 1.5, 1)]
    assert usage.kpis(events).first().failed_sign_ins == 1
    assert usage.totals(usage.since(events, "2024-01-10T00:00:00+00:00", 2)).count() == 0
    # a day is counted once it is closed: when an event comes that is later than it by more than allowed
    (log / "b.json").write_text('{"ts":"2024-01-09T00:00:00+00:00","event":"job_start","user":"b"}\n')
    to_files(daily_jobs(read_usage_stream(spark, str(log))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(str(r.day), r.user, r.value) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("2024-01-02", "a", 1)]


def test_events_are_appended_once(spark, tmp_path):
    """Repeats in one start of the stream or a later one are dropped, and so is what comes too late or can't be told."""
    log, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    log.mkdir()
    line = lambda i, ts, **more: json.dumps({"event_id": i, "ts": ts, "event": "job_end", "user": "a", **more}) + "\n"
    (log / "a.json").write_text(line(1, "2024-01-02T10:00:00+00:00", duration_s=2.5) + line(1, "2024-01-02T10:00:00+00:00") + line(2, "2024-01-02T11:00:00+00:00") + "{broken\n" + line(None, "2024-01-02T11:00:00+00:00") + line(7, "no time"))
    append_events(spark, str(log), out, checkpoint).awaitTermination()
    (log / "b.json").write_text(line(2, "2024-01-02T11:00:00+00:00") + line(3, "2024-01-05T00:00:00+00:00"))
    append_events(spark, str(log), out, checkpoint).awaitTermination()
    (log / "c.json").write_text(line(4, "2024-01-02T12:00:00+00:00") + line(5, "2024-01-04T12:00:00+00:00") + line(3, "2024-01-05T00:00:00+00:00"))
    append_events(spark, str(log), out, checkpoint).awaitTermination()
    append_events(spark, str(log), out, checkpoint).awaitTermination()
    got = sorted((r.event_id, r.day) for r in read_appended(spark, out).collect())
    assert got == [(1, "2024-01-02"), (2, "2024-01-02"), (3, "2024-01-05"), (5, "2024-01-04")]


def test_layout(spark):
    rows = []
    for page in range(3):
        rows.append((1, page, page * 10, f"Head {page}", 8.0, 20.0, 28.0, 1000.0))
        rows += [(1, page, page * 10 + i, "text of the body", 20.0 if i == 1 and page == 0 else 10.0, 200.0 + i * 12, 210.0 + i * 12, 1000.0) for i in range(1, 5)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_idx int, text string, size double, top double, bottom double, page_height double")
    assert layout.without_chrome(lines).count() == 12
    assert layout.body_sizes(lines).first().body == 10.0
    assert [(r.size, r.level) for r in layout.heading_levels(lines).collect()] == [(20.0, 1)]


def test_wire_keeps_tokens(spark):
    rows = [(1, 0, 0, "See `x` now"), (1, 1, 0, "plain"), (1, 2, 0, "and `y` or {z}"), (2, 0, 0, "one")]
    sent = translation.encoded(spark.createDataFrame(rows, "doc_id long, unit_idx int, segment int, text string"))
    got = {r.doc_id: r for r in sent.collect()}
    assert got[1].wire == "[[1]] See ⟦P1⟧ now\n[[2]] plain\n[[3]] and ⟦P2⟧ or ⟦P3⟧" and got[1].spans == ["`x`", "`y`", "{z}"]
    for raw, ok in ((got[1].wire, True), (got[1].wire.replace("⟦P2⟧", ""), False), (got[1].wire + "\n[[3]] again ⟦P2⟧ ⟦P3⟧", True), ("[[2]] plain\n" + got[1].wire, False), ("", False), (None, False)):
        answers = spark.createDataFrame([(1, 0, raw)], "doc_id long, segment int, raw string")
        assert translation.decoded_ok(sent, answers).where("doc_id = 1").first().ok is ok, raw


def test_retry_and_failures(spark):
    long = "a long text that has more than forty characters in it"
    units_ = spark.createDataFrame([(1, 0, 0, long), (1, 1, 1, "short"), (2, 0, 0, long + " x"), (3, 0, 0, "Ada Byron And Grace Hopper And Alan Turing")], "doc_id long, unit_idx int, block_idx int, text string")
    model = lambda text, strict: F.when(F.col("doc_id") == 1, F.when(strict, F.upper(text)).otherwise(text)).when(F.col("doc_id") == 3, text)
    out = translation.translated(units_, model)
    assert [(r.output == r.text.upper(), r.calls, r.failed) for r in out.orderBy("doc_id", "unit_idx").collect()] == [(True, 2, False), (False, 1, False), (False, 2, True), (False, 1, False)]
    assert [tuple(r) for r in translation.failed_blocks(out).collect()] == [(2, 0)]


def test_tagged_runs(spark):
    pieces = [(1, 0, "a", None, True, False, False), (1, 1, "b", None, True, False, False), (1, 2, "c", 1, True, True, False), (1, 3, "d", 1, False, False, True), (1, 4, "e", 2, False, False, False), (1, 5, "f", None, False, False, False)]
    got = translation.tagged(spark.createDataFrame(pieces, "key long, pos int, text string, link int, bold boolean, italic boolean, underline boolean")).first()
    assert got.text == "<b>ab</b><a1><b><i>c</i></b><u>d</u></a1><a2>e</a2>f"


def test_structure_and_models(spark):
    a = spark.createDataFrame([(1, 0, "table", "x | y"), (2, 0, "paragraph", "p"), (3, 0, "paragraph", "p")], "doc_id long, block_idx int, kind string, text string")
    b = spark.createDataFrame([(1, 0, "table", "x | y | z"), (2, 0, "paragraph", "q | r"), (3, 0, "paragraph", "p"), (3, 1, "paragraph", "p")], "doc_id long, block_idx int, kind string, text string")
    assert dict(map(tuple, translation.same_structure(a, b).collect())) == {1: False, 2: True, 3: False}


def test_longest_phrase_claims(spark):
    sheet = spark.createDataFrame([(2, "board", "x"), (3, "board member", "y"), (4, "Member", "z"), (5, "", "w")], "row int, source string, target string")
    texts = spark.createDataFrame([(1, 0, "Board members met the boards; a board, member of it. board member"), (2, 0, "onboarding"), (3, 0, None)], "doc_id long, unit_idx int, text string")
    got = glossary.match_terms(texts, sheet).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, 2), (1, 0, 3, 2), (1, 0, 4, 1)]
    assert glossary.match_terms(texts, sheet.limit(0)).count() == 0


def test_series_fold_beyond_the_slots(spark):
    def log(users):
        return spark.createDataFrame([(i, "2024-01-01T00:00:00+00:00", "job_start", f"u{i}", None, None) for i in range(users)], "pos long, ts string, event string, user string, status string, duration_s double")

    assert {r.series for r in usage.series(log(8), "jobs").collect()} == {f"u{i}" for i in range(8)}
    assert {(r.series, r.value) for r in usage.series(log(9), "jobs").collect()} == {*((f"u{i}", 1.0) for i in range(7)), ("Andere", 2.0)}
    colors = dict(map(tuple, usage.colors(log(10), tuple("abcdefgh")).collect()))
    assert colors == {f"u{i}": "abcdefghhh"[i] for i in range(10)}
    assert [tuple(r) for r in usage.users_in_order(log(10), 4).orderBy("place").collect()] == [(f"u{i}", i + 1) for i in range(10)]


def test_answers_keep_tokens_in_their_line(spark):
    rows = [(1, 0, 0, "see `a` now"), (1, 1, 0, "plain"), (1, 2, 0, "mail x@y.org or {z}")]
    sent = translation.encoded(spark.createDataFrame(rows, "doc_id long, unit_idx int, segment int, text string"))
    wire = sent.first().wire

    def texts(raw):
        return translation.decoded(sent, spark.createDataFrame([(1, 0, raw)], "doc_id long, segment int, raw string")).first().texts

    assert texts(wire) == [r[3] for r in rows]
    assert texts(wire.replace("⟦P1⟧", "?").replace("⟦P2⟧", "⟦P1⟧").replace("?", "⟦P2⟧")) is None
    assert texts(wire.replace("⟦P3⟧", "")) is None and texts("") is None


def test_bytes_fall_back_to_western(spark):
    from termweave.sources.documents import decoded

    data = [(b"\xef\xbb\xbfa\xc3\xa4",), ("“ä€”".encode("cp1252"),), (b"\x81",)]
    got = [r.t for r in spark.createDataFrame(data, "b binary").select(decoded(F.col("b")).alias("t")).collect()]
    assert got == ["aä", "“ä€”", "\ufffd"]
