"""Files of a folder as documents: each type by its own reader, all in one table, with a row for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.results import suffix
from termweave.sources import markdown
from termweave.sources.documents import decoded, paragraphs

#: Types that are read, by their readers.
TYPES = ("md", "txt")
#: Tasks for each core that read the files of one type: Spark counts a file as 4 MB, so small ones would get a task for a few.
_TASKS = 32
_BLOCK = [c.split(" ", 1) for c in markdown.BLOCK_SCHEMA.split(", ")][1:]


def _any_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in name)


def _errors(paths: DataFrame, error: Column) -> DataFrame:
    return paths.select("path", *[F.lit(None).cast(kind).alias(name) for name, kind in _BLOCK], error.alias("error"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, the columns of ``BLOCK_SCHEMA`` but doc_id, and error, for all files below ``path``.

    Markdown (.md) gives its blocks, plain text (.txt) its paragraphs; both as UTF-8, else as Windows-1252. A file of
    another type, or one without text, gives one row with an error and no block. Bytes are read of known types only: the
    others are listed without their content. Names' case doesn't matter; hidden files, and files of no bytes, which
    Spark doesn't list, are left out.
    """
    scan, tasks = spark.read.format("binaryFile").option("recursiveFileLookup", "true"), _TASKS * spark.sparkContext.defaultParallelism
    kind = F.lower(F.substring(suffix(F.col("path")), 2, 20))
    others = scan.load(path).select("path").coalesce(tasks).where(~kind.isin(*TYPES))
    unknown = _errors(others, F.concat(F.lit("file type '"), suffix(F.col("path")), F.lit("' is not supported")))

    def texts(name: str) -> DataFrame:
        # a scan lists the files of its type alone: one that filters them afterwards would read the others, too
        known = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{_any_case(name)}").load(path).select("path", "content").coalesce(tasks)
        return known.where(kind == name).select(F.col("path").alias("doc_id"), decoded(F.col("content")).alias("text"))

    paragraph = lambda p, i: F.struct(*[_given(name, i, p).cast(kind).alias(name) for name, kind in _BLOCK])
    plain = texts("txt").select("doc_id", F.transform(paragraphs(F.col("text")), paragraph).alias("blocks"))
    # a file is one row until here, so none has to be read or met again for those without text
    listed = markdown.block_lists(texts("md")).unionByName(plain)
    row = lambda b, error: F.struct(*[(b[name] if error is None else F.lit(None).cast(kind)).alias(name) for name, kind in _BLOCK], F.lit(error).cast("string").alias("error"))
    found = F.when(markdown.list_has_text(F.col("blocks")), F.transform("blocks", lambda b: row(b, None))).otherwise(F.array(row(None, "the file has no text")))
    return listed.select(F.col("doc_id").alias("path"), F.inline(found)).unionByName(unknown)


def _given(name: str, at: Column, text: Column) -> Column:
    """A paragraph's columns."""
    return {"block_idx": at, "text": text, "rows": F.array()}.get(name, F.lit({"kind": "paragraph", "level": 0, "depth": 0, "ordered": False, "info": "", "translate": True}.get(name)))
