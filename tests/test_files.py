"""Files of several types as one table, blocks to units and back, and a job from blocks to blocks."""

from pyspark.sql import functions as F

from termweave.operators import job, units
from termweave.plans import texts as plans
from termweave.sources import files, markdown


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿# Titel\n\nText ä\n\n| a | b |\n|---|---|\n| c | d |\n".encode())
    (tmp_path / "sub" / "B.TXT").write_bytes("eins\n zwei\n\n\ndrei ß".encode("cp1252"))
    (tmp_path / "c.docx").write_bytes(b"\x00" * 10)
    (tmp_path / "noending").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b" \n\n ")
    (tmp_path / "e.md").write_bytes(b"")
    rows = files.read_files(spark, str(tmp_path)).collect()
    got = sorted((r.path.rsplit("/", 1)[-1], -1 if r.block_idx is None else r.block_idx, r.kind, r.text, r.rows or None, r.error) for r in rows)
    assert got == [
        ("B.TXT", 0, "paragraph", "eins zwei", None, None),
        ("B.TXT", 1, "paragraph", "drei ß", None, None),
        ("a.md", 0, "heading", "Titel", None, None),
        ("a.md", 1, "paragraph", "Text ä", None, None),
        ("a.md", 2, "table", "", [["a", "b"], ["c", "d"]], None),
        ("c.docx", -1, None, None, None, "file type '.docx' is not supported"),
        ("d.txt", -1, None, None, None, "the file has no text"),
        ("noending", -1, None, None, None, "file type '' is not supported"),
    ]


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """A task reads many small files, whatever Spark counts for each, and no file is read for a type that isn't its own."""
    for n in range(40):
        (tmp_path / f"{n}.txt").write_text(f"text {n}\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(files, "_TASKS", 1, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = files.read_files(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
        assert sorted(r.text for r in read.collect()) == sorted(f"text {n}" for n in range(40))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_each_page_has_its_files(spark, tmp_path):
    """Pages that share an id, or have none, keep a file each."""
    texts = ["eins\n\nzwei", None, " \n", "drei"] + [f"text {n}" for n in range(20)]
    ids = [1, 1, None, 2] + [10 + n // 2 for n in range(20)]
    spark.createDataFrame([(i, f"u{n}", t) for n, (i, t) in enumerate(zip(ids, texts))], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.block_idx, r.text, r.error) for r in plans.read_files(spark, str(tmp_path)).collect()), key=str)
    want = [(i, None, None, "file type '.json' is not supported") for i in ids]
    for i, t in zip(ids, texts):
        parts = [x.strip() for x in (t or "").split("\n\n") if x.strip()]
        want += [(i, n, x, None) for n, x in enumerate(parts)] or [(i, None, None, "the file has no text")]
    assert got == sorted(want, key=str)


MD = "# Titel der Anlage\n\nSiehe `code` bei 5 mm. Zweiter Satz hier.\n\n| Name | Wert |\n|---|---|\n| Haus | 3 |\n\n```py\nprint('x')\n```\n\n<div>\nroh\n</div>\n\n- Punkt eins\n"


def test_job_from_blocks_to_blocks(spark):
    """Code and HTML stay, a table's cells are translated each, a long text is cut at sentences and joined again."""
    docs = spark.createDataFrame([(1, MD), (2, "Nur ein Satz."), (3, "kaputt hier"), (4, None), (None, "Ohne Nummer.\n\n| a | b |\n|---|---|\n")], "doc_id long, text string")
    blocks = markdown.markdown_blocks(docs)
    planned = units.planned(blocks, 25)
    got = [(r.unit_idx, r.block_idx, r.cell, r.piece, r.text) for r in planned.where("doc_id = 1").orderBy("unit_idx").collect()]
    assert [x[4] for x in got] == ["Titel der Anlage", "Siehe `code` bei 5 mm.", "Zweiter Satz hier.", "Name", "Wert", "Haus", "Punkt eins"]
    assert [x[3] for x in got] == [0, 0, 1, 0, 0, 0, 0] and [x[2] for x in got] == [0, 0, 0, 0, 1, 2, 0]
    english = units.planned(blocks, 3000, lambda t: F.contains(t, F.lit("Siehe"))).where("doc_id = 1")
    assert english.count() == 5  # 40 characters of the target language are left out

    def model(prompt):
        body = F.substring_index(prompt, "Text to translate:\n", -1)
        return F.struct(F.when(~F.contains(body, F.lit("kaputt")), F.upper(body)).alias("output"), F.lit(None).cast("string").alias("error"))

    done, run = job.translate(blocks, model, job.Languages("de", "en"), limit=25)
    rows = {(r.doc_id, r.block_idx): r for r in done.collect()}
    before = {(r.doc_id, r.block_idx): r for r in blocks.collect()}
    assert rows.keys() == before.keys() and done.columns == blocks.columns
    texts = [rows[1, i].text for i in range(6)]
    assert texts[0] == "TITEL DER ANLAGE" and texts[1] == "SIEHE `code` BEI 5 mm. ZWEITER SATZ HIER." and texts[5] == "PUNKT EINS"
    assert rows[1, 2].rows == [["NAME", "WERT"], ["HAUS", "3"]]
    assert rows[1, 3] == before[1, 3] and rows[1, 4] == before[1, 4] and not rows[1, 4].translate
    assert rows[2, 0].text == "NUR EIN SATZ." and rows[3, 0].text == "kaputt hier"
    assert rows[None, 0].text == "OHNE NUMMER." and rows[None, 1].rows == [["A", "B"]]
    assert run.figures.counts["failed_units"] == 1
