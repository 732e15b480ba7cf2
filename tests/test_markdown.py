"""Markdown and glossary files: what is read, and that it can be written again."""

import io
import zipfile

from pyspark.sql import functions as F

from termweave.operators import language, units
from termweave.sources import glossary, markdown

TEXT = """# Title

- a
- b
  - c
    1. d
    2. e

1. one
   - two
2. three

| A | B \\| C |
|---|---|
| 1 | **x** |

> quote
> more

```py
a ` b

c
```

Setext
======

![alt](p.png)

---

* star
7. seven
8. eight
"""


def test_blocks_and_back(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "![a](b)"), (4, ""), (5, "a\r\nb")], "doc_id long, text string")
    blocks = markdown.markdown_blocks(docs).cache()
    got = [(r.kind, r.text, r.level, r.depth, r.ordered) for r in blocks.where("doc_id = 1").orderBy("block_idx").collect()]
    assert got[0] == ("heading", "Title", 1, 0, False) and ("heading", "Setext", 1, 0, False) in got
    items = [(t, d, o) for k, t, _, d, o in got if k == "list_item"]
    assert items == [("a", 0, False), ("b", 0, False), ("c", 1, False), ("d", 2, True), ("e", 2, True), ("one", 0, True), ("two", 1, False), ("three", 0, True), ("star", 0, False), ("seven", 0, True), ("eight", 0, True)]
    table = blocks.where("kind = 'table'").first()
    assert table.rows == [["A", "B | C"], ["1", "**x**"]]
    code = blocks.where("kind = 'code'").first()
    assert (code.text, code.info, code.translate) == ("a ` b\n\nc", "py", False)
    numbers = {r.text: r.number for r in markdown.numbered(blocks.where("doc_id = 1")).where("kind = 'list_item'").collect()}
    assert numbers == {"a": None, "b": None, "c": None, "d": 1, "e": 2, "one": 1, "two": None, "three": 2, "star": None, "seven": 1, "eight": 2}
    md = {r.doc_id: r.md for r in markdown.markdown_texts(blocks).collect()}
    again = markdown.markdown_blocks(spark.createDataFrame(list(md.items()), "doc_id long, text string"))
    same = {r.doc_id: r.same for r in markdown.same_shape(blocks.where("kind <> 'image_placeholder'"), again.where("kind <> 'image_placeholder' and text not like '[Bild%'")).collect()}
    assert md[5] == "a\nb\n"
    assert dict(map(tuple, markdown.has_text(blocks).collect())) == {1: True, 3: False, 5: True} and same[5]
    assert "| A | B \\| C |\n|---|---|\n" in md[1] and "1. one\n   - two\n\n2. three" in md[1]
    changed = blocks.withColumn("level", F.when(F.col("block_idx") == 0, 2).otherwise(F.col("level")))
    assert not {r.doc_id: r.same for r in markdown.same_shape(blocks, changed).collect()}[1]


def workbook(rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v) + "</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_glossary_files_agree(spark):
    rows = [["DE", " en ", "note"], ["Tür", "door", ""], ["Haus", "house", "n"], ["", "x", ""], ["haus", "house", ""]]
    lines = [" ; ".join(r) for r in rows]
    files = [
        ("a.csv", "\n".join(",".join(r) for r in rows).encode()),
        ("b.csv", "\n".join(lines).encode("cp1252")),
        ("c.tsv", b"\xef\xbb\xbf" + "\n".join("\t".join(r) for r in rows).encode()),
        ("d.xlsx", workbook(rows)),
        ("e.md", ("| " + " | ".join(rows[0]) + " |\n|---|---|---|\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows[1:])).encode()),
        ("f.doc", b""), ("g.xlsx", b"no"), ("h.md", b"text"),
    ]
    read = glossary.glossary_rows(spark.createDataFrame(files, "name string, content binary")).cache()
    assert {r.name: r.error for r in read.where("error is not null").collect()} == {"f.doc": "unknown_type", "g.xlsx": "broken_xlsx", "h.md": "no_table"}
    for name, _ in files[:5]:
        pair = glossary.language_pair(read.where(F.col("name") == name), "de", "en")
        assert sorted((r.row, r.source, r.target) for r in pair.collect()) == [(2, "Tür", "door"), (3, "Haus", "house"), (4, "", "x"), (5, "haus", "house")], name
    one = read.where("name = 'a.csv'")
    assert {r.row: r.issue for r in glossary.terms_and_issues(one, "de", "en").collect()} == {2: None, 3: None, 4: "empty_cell", 5: "duplicate"}
    assert glossary.language_pair(one, "de", "fr").count() == 0
    assert [tuple(r) for r in glossary.missing_languages(one, "de", "fr").collect()] == [("a.csv", ["fr"], ["de", "en"])]


def test_pieces_are_whole_or_none(spark):
    rows = [(1, 0, 0, 1, "b"), (1, 0, 0, 0, "a"), (1, 1, 0, 0, "c"), (1, 1, 0, 1, None)]
    got = units.joined_pieces(spark.createDataFrame(rows, "doc_id long, block_idx int, cell int, piece int, output string")).collect()
    assert {r.block_idx: r.text for r in got} == {0: "a b", 1: None}


def test_language_rules(spark):
    english, german = "the house is on the hill and the door is open. ", "das haus steht auf dem berg und die tür ist offen. "
    counts = language.gram_counts(spark.createDataFrame([("en", english * 3), ("de", german * 3)], "lang string, text string"))
    pairs = spark.createDataFrame([(1, english, "  " + english.replace(" ", "  ")), (2, english, german), (3, "short", "short"), (4, english, english.replace("hill", "rock"))], "doc_id long, source string, output string")
    got = {r.doc_id: r.untranslated for r in language.looks_untranslated(pairs, counts, "en", "de").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    texts = spark.createDataFrame([(1, german + "<b>" + english + "</b>"), (2, german), (3, None), (4, "the house.")], "doc_id long, text string")
    assert {r.doc_id: r.has_sentence for r in language.has_source_sentence(texts, counts, "en").collect()} == {1: True, 2: False, 3: False, 4: False}
    found = {r.doc_id: r.in_language for r in language.is_in_language(texts, counts, "de").collect()}
    assert found[2] and not found[3] and not found[4]
