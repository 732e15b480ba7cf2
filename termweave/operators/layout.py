"""Page lines to blocks: repeated headers and footers, body size, heading levels, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The share of a page's height, above and below, where headers and footers stand.
MARGIN = 0.1


def _in_margin(height: Column) -> Column:
    return (F.col("top") < MARGIN * height) | (F.col("bottom") > (1 - MARGIN) * height)


def line_size(sizes: Column) -> Column:
    """A line's font size: the higher median of its characters' sizes, to the nearest half; 0 without any."""
    return F.bround(F.coalesce(F.get(F.array_sort(sizes), F.floor(F.size(sizes) / 2).cast("int")), F.lit(0.0)) * 2) / 2


def without_chrome(lines: DataFrame) -> DataFrame:
    """Lines but for those that repeat in margins: text, digits aside, in the margins of 60 % of a document's pages, two at least.

    Where a text stands counts by its own page's height; what is removed by the height of the document's first page.
    """
    marked = lines.withColumn("_sign", F.regexp_replace("text", r"\p{Nd}+", "#"))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.min_by("page_height", "page").alias("_first"))
    on = marked.where(_in_margin(F.col("page_height"))).groupBy("doc_id", "_sign").agg(F.count_distinct("page").alias("on"))
    signs = on.join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 6 / 10))).select("doc_id", "_sign", "_first")
    joined = marked.join(signs, ["doc_id", "_sign"], "left")
    return joined.where(F.col("_first").isNull() | ~_in_margin(F.col("_first"))).select(*lines.columns)


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, body: the font size with the most characters, the first seen of equals."""
    sizes = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("line_idx").alias("first"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body"))


def heading_levels(lines: DataFrame) -> DataFrame:
    """doc_id, size, level: sizes of 1.15 times the body's or more, ranked from the largest, level 6 at most."""
    large = lines.select("doc_id", "size").distinct().join(body_sizes(lines), "doc_id").where(F.col("size") >= 1.15 * F.col("body"))
    return large.select("doc_id", "size", F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("size").desc())), F.lit(6)).alias("level"))


def _in_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with level and block.

    Headings of one level go on where they follow closely on one page. A paragraph goes on over a page's end unless a
    sentence ended there, and within a page unless the gap is more than half the body's size.
    """
    levelled = lines.join(body_sizes(lines), "doc_id").join(heading_levels(lines), ["doc_id", "size"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    level, page, bottom, text = (F.lag(c).over(order) for c in ("level", "page", "bottom", "text"))
    gap, other_page = F.col("top") - bottom, page != F.col("page")
    heading = other_page | (gap > 0.5 * F.col("size"))
    paragraph = F.when(other_page, text.rlike(r"[.!?:]\z")).otherwise(gap > 0.5 * F.col("body"))
    new = level.isNull() | (level != F.col("level")) | F.when(F.col("level") > 0, heading).otherwise(paragraph)
    return levelled.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("block", F.sum("_new").over(order) - 1)


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, block, level, n_lines: lines joined until size, page or distance tells a new block."""
    return _in_blocks(lines).groupBy("doc_id", "block").agg(F.max("level").alias("level"), F.count("*").alias("n_lines"))


def block_texts(lines: DataFrame) -> DataFrame:
    """doc_id, block, level, text: each block's lines joined by a space; a word that a hyphen cuts before a small letter is one."""
    following = F.lead("text").over(Window.partitionBy("doc_id", "block").orderBy("line_idx"))
    glued = F.col("text").rlike(r"\p{L}-\z") & following.rlike(r"^\p{Ll}")
    piece = F.when(following.isNull(), F.col("text")).when(glued, F.expr("left(text, length(text) - 1)")).otherwise(F.concat("text", F.lit(" ")))
    rows = _in_blocks(lines).withColumn("_piece", piece)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "_piece"))), lambda x: x["_piece"]), "")
    return rows.groupBy("doc_id", "block").agg(F.max("level").alias("level"), text.alias("text"))
