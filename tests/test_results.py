"""Reports, previews, prompts, tags, file names and the benchmark's document on small cases."""

import csv
import io

from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import benchmark, layout, results

BLOCK = "doc_id bigint, block_idx int, kind string, text string, level int, depth int, ordered boolean, rows array<array<string>>, info string, translate boolean"


def block(doc, idx, kind, text, rows=()):
    return (doc, idx, kind, text, 1 if kind == "heading" else 0, 0, False, [list(r) for r in rows], "", True)


def test_tag_pieces(spark):
    cases = {
        "a<b>c<i>d</i></b><a2>e<u>f</u></a2>": [("a", False, False, False, 0), ("c", True, False, False, 0), ("d", True, True, False, 0), ("e", False, False, False, 2), ("f", False, False, True, 2)],
        "plain": [("plain", False, False, False, 0)],
        "": [],
        "<b>a</i>": None,
        "<b>a": None,
        "a</b>": None,
        "<b><i>x</b></i>": None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.p for r in frame.select("t", fn.tag_pieces(F.col("t"), fn.opening_tags(F.col("t"))).alias("p")).collect()}
    assert {t: None if p is None else [tuple(x) for x in p] for t, p in got.items()} == cases
    other = spark.createDataFrame([("<b>x</b>", ["i"]), ("x", ["b"]), ("<b>x</b><b>y</b>", ["b"])], "t string, e array<string>")
    assert [r.p for r in other.select(fn.tag_pieces(F.col("t"), F.col("e")).alias("p")).collect()] == [None] * 3


def test_scalars(spark):
    row = spark.range(1).select(
        fn.emphasised(F.lit("  a b \n"), F.lit(True), F.lit(True)).alias("e"),
        fn.emphasised(F.lit(" a"), F.lit(False), F.lit(False)).alias("plain"),
        fn.emphasised(F.lit("  "), F.lit(True), F.lit(False)).alias("blank"),
        fn.run_markup(F.struct(F.lit("a<&\nb").alias("text"), F.lit(True).alias("bold"), F.lit(True).alias("italic"), F.lit(False).alias("code"), F.lit('x"y').alias("href"))).alias("m"),
        fn.stars(F.lit(2)).alias("s"),
        results.output_name(F.lit("a/b.c.DOCX"), F.lit("en"), F.lit("md")).alias("n"),
        F.array(*[results.suffix(F.lit(x)) for x in ("a.md", "x/.rc", "a.b/c", "a.")]).alias("suffixes"),
        results.mime_type(F.lit("pdf")).alias("mime"),
        results.upload_key(F.lit("a"), F.lit(3), F.lit(None)).alias("key"),
        results.size_kb(F.lit(1900)).alias("kb"),
        layout.line_size(F.array(F.lit(10.0), F.lit(9.0), F.lit(10.26), F.lit(10.3))).alias("size"),
        layout.line_size(F.array().cast("array<double>")).alias("no_size"),
    ).first()
    assert tuple(row) == ("  ***a b*** \n", " a", "  ", '<a href="x&quot;y" color="#0563C1"><i><b>a&lt;&amp;<br/>b</b></i></a>', "★★☆", "b.c_en.md", [".md", "", "", ""], "application/pdf", "a:3:", 1.9, 10.5, 0.0)


def test_report_and_preview(spark):
    blocks = spark.createDataFrame([block(1, 0, "heading", "Costs $5"), block(1, 1, "paragraph", '<b>He</b> said "no", twice'), block(1, 2, "table", "", [["a", "b"], ["c", "d"]]), block(2, 0, "paragraph", "x")], BLOCK)
    at = lambda *places: spark.createDataFrame([*places], "doc_id bigint, block_idx int")
    failed = at((1, 2))
    mixed = results.left_mixed(at((1, 2), (1, 1), (1, 1)), failed)
    assert [tuple(r) for r in mixed.collect()] == [(1, 1)]
    assert sorted(tuple(r) for r in results.highlighted(at((1, 1), (2, 0)), mixed).collect()) == [(1, 1), (2, 0)]
    more = spark.createDataFrame([(1, "untouched", 0, "footnotes", None, None), (1, "term", 1, "He", "he", "er")], "doc_id bigint, kind string, place int, detail string, source string, expected string")
    rows = results.excerpts(blocks, failed, "failed").unionByName(results.excerpts(blocks, mixed, "language")).unionByName(more)
    text = results.report_csv(rows).first().csv
    out = io.StringIO()
    csv.writer(out).writerows([["kind", "detail", "source", "expected"], ["term", "He", "he", "er"], ["failed", "a | b | c | d", "", ""], ["language", 'He said "no", twice', "", ""], ["untouched", "footnotes", "", ""]])
    assert text == "\ufeff" + out.getvalue()
    md = {r.doc_id: r.md for r in results.previews(blocks, results.marked_blocks(failed, mixed)).collect()}
    assert "\\$5" in md[1] and "⚠️ <b>He" in md[1] and md[1].count("⚠️") == 1 and md[2] == "x\n"


def test_prompts(spark):
    schema = "body string, entries array<struct<source:string,target:string,note:string>>, missed array<struct<source:string,target:string,note:string>>, context struct<source:string,output:string>, strict boolean, untranslated boolean"
    rows = [("[[1]] <b>x</b>", [("a", "b", "n"), ("c", "d", "")], [("a", "b", "")], ("s", "o"), True, True), ("[[1]] x", None, None, None, False, True)]
    got = results.full_prompts(spark.createDataFrame(rows, schema), "de", "en").withColumn("m", results.messages(F.col("prompt"))).collect()
    system, user = got[0].m
    assert (system.role, user.role) == ("system", "user") and "from German to English." in system.content and "- Keep tags such as" in system.content
    assert user.content.split("\n\n") == [
        'Mandatory terminology. Use exactly these target terms:\n- "a" -> "b" (note: n)\n- "c" -> "d"',
        'IMPORTANT: the previous answer was rejected. Follow the ID, token and terminology rules exactly. Missing: "b" for "a"',
        "Translate every line completely into English; leave nothing in German.",
        "Context (already translated, do not repeat it):\nSource: s\nTranslation: o",
        "Translate every numbered line into English. Answer only in English.\nText to translate:\n[[1]] <b>x</b>",
    ]
    assert "Keep tags" not in got[1].m[0].content and got[1].m[1].content.startswith("Translate every numbered line")
    assert [tuple(x) for x in spark.range(1).select(results.messages(F.lit("no system")).alias("m")).first().m] == [("user", "no system")]


def test_fixture_and_table(spark):
    blocks = benchmark.fixture(spark, 4).orderBy("block_idx").collect()
    assert [b.block_idx for b in blocks] == list(range(4 * 7 + 1))
    assert [b.kind for b in blocks[14:23]] == ["heading"] + ["paragraph"] * 6 + ["table", "heading"] and len(blocks[21].rows) == 4
    n = 0
    for b in blocks:
        if b.kind == "paragraph":
            expected = []
            for _ in range(5):
                expected.append(benchmark.SENTENCES[n % 5].replace("{a}", benchmark.TERMS[n % 10][0]).replace("{b}", benchmark.TERMS[(3 * n + 1) % 10][0]))
                n += 1
            assert b.text == " ".join(expected)
    rows = [(0, "x:1b", 12.5, 3, 4, 8, 1, 0, 2), (1, "y", 1.0, 1, 1, 0, 0, 1, 0)]
    results_ = spark.createDataFrame(rows, "pos int, model string, seconds double, segments int, calls int, hits int, misses int, failed int, untranslated int")
    assert benchmark.results_table(results_).first().md.split("\n")[2:] == ["| x:1b | 12 s | 3 | 4 | 8 | 1 | 88% | 0 | 2 |", "| y | 1 s | 1 | 1 | 0 | 0 | 100% | 1 | 0 |"]
    assert [r.file for r in benchmark.result_files(results_).collect()] == ["x_1b.md", "y.md"]


def test_wide_and_block_texts(spark):
    blocks = spark.createDataFrame([block(1, 0, "table", "", [["x"] * 9]), block(2, 0, "table", "", [["x"] * 8]), block(3, 0, "paragraph", "x")], BLOCK)
    assert dict(map(tuple, results.wide_tables(blocks).collect())) == {1: True, 2: False, 3: False}
    size, rows = 10.0, [(0, "A long trans-", 100.0), (0, "lation of", 112.0), (1, "a text.", 100.0), (2, "Next one", 100.0), (2, "far off", 140.0)]
    lines = spark.createDataFrame([(1, p, i, t, size, top, top + size, 1000.0) for i, (p, t, top) in enumerate(rows)], "doc_id long, page int, line_idx int, text string, size double, top double, bottom double, page_height double")
    assert [r.text for r in layout.block_texts(lines).orderBy("block").collect()] == ["A long translation of a text.", "Next one", "far off"]
