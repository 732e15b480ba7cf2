"""From blocks to translatable units, segments, prompts and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as fn


def _by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by ``keys`` in which a null is a key like others; ``right`` adds its other columns."""
    other = right.select(*[F.col(k).alias(f"_by_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return left.join(other, same, how).drop(*[f"_by_{k}" for k in keys])


def _cells(blocks: DataFrame) -> Column:
    """A block's texts: a table's cells in order of rows (``rows``, else its text cut at bars), other blocks' whole text."""
    cells = F.flatten("rows") if "rows" in blocks.columns else F.split("text", r" \| ")
    return F.when(F.col("kind") == "table", cells).otherwise(F.array("text"))


def units(blocks: DataFrame) -> DataFrame:
    """doc_id, unit_idx, block_idx, cell, text: table cells apart, other blocks whole; those with a letter.

    Blocks with ``translate`` false (code, HTML) are left out; cells are numbered through a table's rows.
    """
    wanted = blocks.where("translate") if "translate" in blocks.columns else blocks
    texts = F.transform(_cells(blocks), lambda t, i: F.struct(i.alias("cell"), t.alias("text")))
    return _in_place(wanted, F.filter(texts, lambda c: c["text"].rlike(r"\p{L}"))).select("doc_id", "unit_idx", "block_idx", "cell", "text")


def _in_place(blocks: DataFrame, texts: Column) -> DataFrame:
    """doc_id, block_idx, unit_idx and fields of ``texts`` (array of structs, in order), numbered through a document: blocks are sorted, not their texts."""
    rows = blocks.select("doc_id", "block_idx", texts.alias("_texts")).where(F.size("_texts") > 0)
    before = Window.partitionBy("doc_id").orderBy("block_idx", F.get("_texts", F.lit(0))["cell"]).rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("_start", F.coalesce(F.sum(F.size("_texts")).over(before), F.lit(0)))
    each = started.select("doc_id", "block_idx", "_start", F.posexplode("_texts").alias("_at", "_text"))
    return each.select("doc_id", "block_idx", (F.col("_start") + F.col("_at")).cast("int").alias("unit_idx"), "_text.*")


def planned(blocks: DataFrame, limit: int = 3000, reads_as_target=None) -> DataFrame:
    """doc_id, unit_idx, block_idx, cell, piece, text: ``units``, long ones cut between sentences, numbered anew.

    ``reads_as_target`` (a function of a column) leaves out texts of 40 characters or more that are in the target
    language already; it sees them without formatting tags.
    """
    wanted = blocks.where("translate") if "translate" in blocks.columns else blocks
    texts = F.filter(F.transform(_cells(blocks), lambda t, i: F.struct(i.alias("cell"), t.alias("text"))), lambda c: c["text"].rlike(r"\p{L}"))
    if reads_as_target is not None:
        # a judge may run in Python, which no lambda can hold: it sees a row for each text
        found = wanted.select("doc_id", "block_idx", F.inline(texts))
        bare = fn.without_tags(F.col("text"))
        wanted = found.where(~((F.length(bare) >= 40) & F.coalesce(reads_as_target(bare), F.lit(False))))
        texts = F.array(F.struct("cell", "text"))
    piece = lambda c: F.transform(_pieces(c["text"], limit), lambda p, i: F.struct(c["cell"].alias("cell"), i.alias("piece"), p.alias("text")))
    return _in_place(wanted, F.flatten(F.transform(texts, piece))).select("doc_id", "unit_idx", "block_idx", "cell", "piece", "text")


def _packing(sizes: Column, limit: int, gap: int) -> Column:
    """Bin number of each size in order: a bin holds sizes up to ``limit`` (and ``gap`` between them)."""
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("bins"))

    def step(acc: Column, size: Column) -> Column:
        fits = (acc["bin"] >= 0) & (acc["used"] + gap + size <= limit)
        number = F.when(fits, acc["bin"]).otherwise(acc["bin"] + 1)
        return F.struct(number.alias("bin"), F.when(fits, acc["used"] + gap + size).otherwise(size).alias("used"), F.concat(acc["bins"], F.array(number)).alias("bins"))

    return F.aggregate(sizes, start, step, lambda acc: acc["bins"])


def segments(units: DataFrame, limit: int = 3000) -> DataFrame:
    """``units`` with segment: consecutive units of a document whose lengths sum up to ``limit`` at most.

    A document's units are packed in one row, as long as the document, so units are read once and aren't joined.
    """
    own = [c for c in units.columns if c not in ("doc_id", "unit_idx")]
    rows = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit_idx", F.struct(F.length("text").alias("size"), *own).alias("own")))).alias("rows"))
    bins = rows.withColumn("bins", _packing(F.transform("rows", lambda r: r["own"]["size"]), limit, 0))
    each = bins.select("doc_id", F.explode(F.arrays_zip(F.col("rows").alias("unit"), F.col("bins").alias("segment"))).alias("z"))
    return each.select("doc_id", *[F.col(f"z.unit.{c}" if c == "unit_idx" else f"z.unit.own.{c}").alias(c) for c in units.columns if c != "doc_id"], F.col("z.segment").alias("segment")).select(*units.columns, "segment")


def sentence_pieces(units: DataFrame, limit: int = 1500) -> DataFrame:
    """doc_id, unit_idx, piece, text: units longer than ``limit`` cut between sentences, others whole."""
    return units.select("doc_id", "unit_idx", F.posexplode(_pieces(F.col("text"), limit)).alias("piece", "text"))


def _pieces(text: Column, limit: int) -> Column:
    """The pieces of a text."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + 1 + F.length(s) <= limit
        longer = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit(" "), s).alias("now"))
        return F.when(fits, longer).otherwise(F.struct(F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"), s.alias("now")))

    cut = F.aggregate(fn.sentences(text), start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
    return F.when(F.length(text) > limit, cut).otherwise(F.array(F.coalesce(text, F.lit(""))))


def wire_lines(answers: DataFrame) -> DataFrame:
    """id of answers (key, raw) cut at markers ``[[n]]``: key, seq, id, text; lines before the first are dropped."""
    lines = answers.select("key", F.posexplode(F.split(fn.clean_answer(F.col("raw")), "\n")).alias("at", "line"))
    number = F.regexp_extract("line", r"^\[\[([0-9]+)\]\]", 1)
    marked = lines.withColumn("id", F.when(number != "", number.cast("int"))).withColumn("seq", F.count("id").over(Window.partitionBy("key").orderBy("at")))
    body = F.regexp_replace("line", r"^\[\[[0-9]+\]\] ?", "")
    return marked.where("seq > 0").groupBy("key", "seq").agg(F.max("id").alias("id"), F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", body.alias("b")))), lambda x: x["b"]), "\n")).alias("text"))


def last_per_run(records: DataFrame) -> DataFrame:
    """Of neighbouring records with one id only the last."""
    following = F.lead("id").over(Window.partitionBy("key").orderBy("seq"))
    return records.withColumn("_next", following).where("_next is null or _next <> id").drop("_next")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """doc_id, block_idx, cell, text of pieces (doc_id, block_idx, cell, piece, output): joined by a space in order.

    A text of which any piece has no output has none: it isn't mixed of two languages.
    """
    return pieces.groupBy("doc_id", "block_idx").agg(_by_cell().alias("cells")).select("doc_id", "block_idx", F.inline("cells"))


def _by_cell() -> Column:
    """Aggregate of a block's pieces: cell and text of each cell, in order."""

    def cells(rows: Column) -> Column:
        numbered = F.transform(rows, lambda x, i: F.struct(x["cell"].alias("cell"), i.alias("at")))
        firsts = F.filter(numbered, lambda x, i: (i == 0) | ~x["cell"].eqNullSafe(F.get(rows, i - 1)["cell"]))
        return fn.let(firsts, lambda f: F.transform(f, lambda x, i: F.struct(x["cell"].alias("cell"), whole(F.slice(rows, x["at"] + 1, F.coalesce(F.get(f, i + 1)["at"], F.size(rows)) - x["at"])).alias("text"))))

    def whole(own: Column) -> Column:
        return F.when(F.forall(own, lambda p: p["output"].isNotNull()), F.array_join(F.transform(own, lambda p: p["output"]), " "))

    return fn.let(F.sort_array(F.collect_list(F.struct("cell", "piece", "output"))), cells)


def assemble(blocks: DataFrame, outputs: DataFrame) -> DataFrame:
    """``blocks`` with texts from ``outputs`` (doc_id, block_idx, cell, text; or piece and output); cells without one keep their own text.

    Blocks with ``rows`` get their tables' rows back in shape, and keep their other columns. A block's cells meet its
    outputs in its row, so blocks and outputs move once and no cell is joined.
    """
    said = _by_cell() if "piece" in outputs.columns else F.collect_list(F.struct("cell", "text"))
    given = outputs.groupBy("doc_id", "block_idx").agg(said.alias("_said"))
    # cells are cut after the join: a block's text moves once
    whole = _by(blocks, given, ["doc_id", "block_idx"], "left").withColumn("_cells", _cells(blocks))
    kept = F.filter(F.coalesce("_said", F.array().cast("array<struct<cell int, text string>>")), lambda c: c["text"].isNotNull() & (c["cell"] < F.size("_cells")))
    shape = lambda cell, own, text: F.struct(cell.cast("int").alias("cell"), F.lit(own).alias("own"), text.alias("text"))
    both = F.concat(F.transform(kept, lambda c: shape(c["cell"], 0, c["text"])), F.transform("_cells", lambda t, i: shape(i, 1, t)))
    firsts = lambda a: F.filter(a, lambda x, i: (i == 0) | (x["cell"] != F.get(a, i - 1)["cell"]))
    texts = F.transform(fn.let(F.sort_array(both), firsts), lambda x: x["text"])
    if "rows" not in blocks.columns:
        return whole.select("doc_id", "block_idx", "kind", F.array_join(texts, " | ").alias("text"))
    whole, table = whole.withColumn("_texts", texts), F.col("kind") == "table"
    # where each row's cells begin
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    begins = F.aggregate("rows", start, lambda acc, r: F.struct((acc["n"] + F.size(r)).alias("n"), F.concat(acc["at"], F.array(acc["n"])).alias("at")), lambda acc: acc["at"])
    row = lambda r, n: F.slice("_texts", n + 1, F.size(r))
    return whole.withColumn("text", F.when(table, F.col("text")).otherwise(F.get("_texts", F.lit(0)))).withColumn("rows", F.when(table & (F.size("_texts") > 0), F.zip_with("rows", begins, row)).otherwise(F.col("rows"))).select(*blocks.columns)


def context_pairs(turns: DataFrame) -> DataFrame:
    """For each turn the last earlier turn of its conversation with a text: conv_id, turn, context."""
    good = F.when(F.length("text") > 0, F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", F.last(good, ignorenulls=True).over(before).alias("context"))


def markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, md: blocks rendered in order, one blank line apart; headings with #, tables as a row of their header and one of dashes."""
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("# "), F.col("text"))).when(F.col("kind") == "table", F.concat(F.lit("| "), F.col("text"), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size(F.split("text", r" \| "))))).otherwise(F.col("text"))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", shown.alias("s")))), lambda x: x["s"]), "\n\n").alias("md"))
