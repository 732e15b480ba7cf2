"""Markdown documents as tables of blocks, and back.

A document is parsed by one small helper in an Arrow batch: blocks depend on the lines before them, so no column
expression can tell them. Supported are headings of both forms, nested lists, quotes, fenced and indented code, tables,
rules, HTML blocks and paragraphs; inline syntax stays in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SCHEMA = "doc_id bigint, block_idx int, kind string, text string, level int, depth int, ordered boolean, rows array<array<string>>, info string, translate boolean"
_FIELDS = [("block_idx", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("depth", pa.int32()), ("ordered", pa.bool_()), ("rows", pa.list_(pa.list_(pa.string()))), ("info", pa.string()), ("translate", pa.bool_())]
#: Characters of documents whose blocks a worker holds at once, beside the document that reaches over it.
_HELD = 1 << 20
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r"^( {0,3})([-*+]|[0-9]{1,9}[.)])(?:([ \t]+)(.*)|$)")
_QUOTE = re.compile(r"^ {0,3}> ?")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r"^ {0,3}<(?:!--|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_IMAGE = re.compile(r"!\[([^\]]*)\]\([^)]*\)")
#: Depths of lists that are numbered apart; deeper ones count as this depth.
DEEPEST = 8
_CELL_END = re.compile(r"(?<!\\)\|")


def _block(kind: str, text: str = "", **more) -> dict:
    return {"kind": kind, "text": text, "level": 0, "depth": 0, "ordered": False, "rows": [], "info": "", "translate": True} | more


def _cells(line: str) -> list[str]:
    inner = line.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [c.strip().replace("\\|", "|") for c in _CELL_END.split(inner)]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class _Reader:
    """Blocks of lines; containers (lists, quotes) hand their inner lines to a reader of their own."""

    def __init__(self, lists: tuple[bool, ...] = (), quoted: bool = False):
        self.lists, self.quoted, self.first_in_item = lists, quoted, bool(lists)
        self.blocks: list[dict] = []

    def paragraph(self, lines: list[str]) -> None:
        text = "\n".join(line.strip() for line in lines)
        if self.first_in_item:
            self.first_in_item = False
            self.blocks.append(_block("list_item", text, depth=len(self.lists) - 1, ordered=self.lists[-1]))
        elif self.quoted:
            self.blocks.append(_block("quote", text))
        elif image := _IMAGE.fullmatch(text):
            self.blocks.append(_block("image_placeholder", f"[Bild: {image.group(1)}]", translate=False))
        else:
            self.blocks.append(_block("paragraph", text))

    def read(self, lines: list[str]) -> list[dict]:
        at = 0
        while at < len(lines):
            at = self.next(lines, at)
        return self.blocks

    def next(self, lines: list[str], at: int) -> int:
        line = lines[at]
        if not line.strip():
            return at + 1
        if _indent(line) >= 4:
            return self.code(lines, at)
        if fence := _FENCE.match(line):
            return self.fence(lines, at, fence)
        if heading := _HEADING.match(line):
            self.blocks.append(_block("heading", (heading.group(2) or "").strip(), level=len(heading.group(1))))
            return at + 1
        if _RULE.match(line):
            self.blocks.append(_block("page_break", translate=False))
            return at + 1
        if _QUOTE.match(line):
            return self.quote(lines, at)
        if _ITEM.match(line):
            return self.items(lines, at)
        if _HTML.match(line):
            end = next((i for i in range(at, len(lines)) if not lines[i].strip()), len(lines))
            self.blocks.append(_block("paragraph", "\n".join(lines[at:end]).strip(), translate=False))
            return end
        if at + 1 < len(lines) and "|" in line and _DELIMITER.match(lines[at + 1]) and len(_cells(line)) == len(_cells(lines[at + 1])):
            return self.table(lines, at)
        return self.text(lines, at)

    def starts_other(self, line: str) -> bool:
        """Whether a line ends the paragraph before it."""
        item = _ITEM.match(line)
        return bool(not line.strip() or _HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or (item and (item.group(4) or "").strip() and item.group(2) in ("-", "*", "+", "1.", "1)")))

    def text(self, lines: list[str], at: int) -> int:
        end = at + 1
        while end < len(lines):
            if (under := _UNDERLINE.match(lines[end])) and not self.first_in_item:
                text = "\n".join(line.strip() for line in lines[at:end])
                self.blocks.append(_block("heading", text, level=1 if under.group(1)[0] == "=" else 2))
                return end + 1
            if self.starts_other(lines[end]):
                break
            end += 1
        self.paragraph(lines[at:end])
        return end

    def code(self, lines: list[str], at: int) -> int:
        end = at
        while end < len(lines) and (not lines[end].strip() or _indent(lines[end]) >= 4):
            end += 1
        text = "\n".join(line[4:] for line in lines[at:end]).rstrip("\n")
        self.blocks.append(_block("code", text.rstrip(), translate=False))
        return end

    def fence(self, lines: list[str], at: int, fence: re.Match) -> int:
        mark, inset = fence.group(2), len(fence.group(1))
        closing = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        end = next((i for i in range(at + 1, len(lines)) if closing.match(lines[i])), len(lines))
        body = [line[min(inset, _indent(line)) :] for line in lines[at + 1 : end]]
        self.blocks.append(_block("code", "\n".join(body).rstrip("\n"), info=fence.group(3).strip(), translate=False))
        return end + 1

    def quote(self, lines: list[str], at: int) -> int:
        inner, end = [], at
        while end < len(lines) and lines[end].strip():
            # a line without the mark goes on with the quote's paragraph
            if not _QUOTE.match(lines[end]) and (not inner or not inner[-1].strip() or self.starts_other(lines[end])):
                break
            inner.append(_QUOTE.sub("", lines[end], count=1))
            end += 1
        reader = _Reader(self.lists, True)
        reader.first_in_item = self.first_in_item
        self.blocks += reader.read(inner)
        self.first_in_item = reader.first_in_item
        return end

    def items(self, lines: list[str], at: int) -> int:
        item = _ITEM.match(lines[at])
        marker, gap, rest = item.group(2), item.group(3) or " ", item.group(4) or ""
        width = len(item.group(1)) + len(marker) + (len(gap) if len(gap) < 5 and rest else 1)
        inner, end = [rest if len(gap) < 5 else gap[1:] + rest], at + 1
        while end < len(lines):
            line = lines[end]
            if not line.strip():
                following = next((x for x in lines[end:] if x.strip()), "")
                if _indent(following) < width:
                    break
                inner.append("")
            elif _indent(line) >= width:
                inner.append(line[width:])
            elif inner[-1].strip() and not self.starts_other(line) and not _ITEM.match(line):
                inner.append(line.strip())
            else:
                break
            end += 1
        self.blocks += _Reader((*self.lists, marker[-1] in ".)"), self.quoted).read(inner)
        return end

    def table(self, lines: list[str], at: int) -> int:
        rows, end = [_cells(lines[at])], at + 2
        while end < len(lines) and lines[end].strip() and not self.starts_other(lines[end]):
            own = _cells(lines[end])
            rows.append((own + [""] * len(rows[0]))[: len(rows[0])])
            end += 1
        self.blocks.append(_block("table", rows=rows))
        return end


def parse(text: str) -> list[dict]:
    """The blocks of one document."""
    return _Reader().read(text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"))


def _gathered(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows (size in characters, row): one for each ``_HELD`` characters, however long an incoming batch is."""
    rows, size = [], 0
    for own, row in found:
        rows.append(row)
        size += own
        if size >= _HELD:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def block_lists(docs: DataFrame) -> DataFrame:
    """doc_id (a number or a name) and blocks (``BLOCK_SCHEMA`` but doc_id) of every document, in one row each: a null or blank text has none."""
    names = docs.schema["doc_id"].dataType.simpleString() == "string"
    kind, fields = ("string", pa.string()) if names else ("bigint", pa.int64())
    schema = pa.schema([("doc_id", fields), ("blocks", pa.list_(pa.struct(_FIELDS)))])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((i.as_py(), text.as_py() or "") for batch in batches for i, text in zip(batch.column(0), batch.column(1), strict=True))
        return _gathered(((len(text), {"doc_id": i, "blocks": [{"block_idx": n, **block} for n, block in enumerate(parse(text))]}) for i, text in texts), schema)

    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInArrow(parsed, f"doc_id {kind}, blocks array<struct<{BLOCK_SCHEMA.split(', ', 1)[1]}>>")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of every document (doc_id, a number or a name, and text): ``BLOCK_SCHEMA``. A null or blank text has none; other columns aren't read."""
    return block_lists(docs).select("doc_id", F.inline("blocks"))


def _shown(kind: Column, text: Column, rows: Column) -> Column:
    return ~kind.isin("image_placeholder", "page_break") & ((F.trim(text) != "") | (F.size(rows) > 0))


def has_text(blocks: DataFrame) -> DataFrame:
    """doc_id, has_text: whether a document has text beside images and breaks."""
    return blocks.groupBy("doc_id").agg(F.bool_or(_shown(F.col("kind"), F.col("text"), F.col("rows"))).alias("has_text"))


def list_has_text(blocks: Column) -> Column:
    """``has_text`` of a document's list of blocks."""
    return F.exists(blocks, lambda b: _shown(b["kind"], b["text"], b["rows"]))


def numbered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with number: an ordered item's place in its list, null for others.

    A list of a depth ends at any block that is no item, at an item of lesser depth and at an unordered one of its own.
    """
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    item = F.col("kind") == "list_item"
    # by depth the last block that ends a list of that depth; a fold over a few depths, not over the document
    shallow = F.transform(F.sequence(F.lit(0), F.lit(DEEPEST)), lambda d: F.when(~item | (F.col("depth") < d) | ((F.col("depth") == d) & ~F.col("ordered")), F.col("block_idx")))
    at = blocks.withColumn("_ends", shallow)
    last = F.coalesce(*[F.when(F.least("depth", F.lit(DEEPEST)) == d, F.max(F.col("_ends")[d]).over(order)) for d in range(DEEPEST + 1)], F.lit(-1))
    same = Window.partitionBy("doc_id", "depth", "_list", "ordered").orderBy("block_idx")
    at = at.withColumn("_list", F.coalesce(last, F.lit(-1)))
    return at.withColumn("number", F.when(item & F.col("ordered"), F.row_number().over(same))).drop("_ends", "_list")


def _piece(block: dict, widths: list[int], counters: dict[int, int]) -> str:
    kind, text = block["kind"], block["text"]
    if kind == "list_item":
        depth = block["depth"]
        del widths[depth:]
        for deeper in [d for d in counters if d > depth]:
            del counters[deeper]
        widths += [2] * (depth - len(widths))
        if block["ordered"]:
            counters[depth] = counters.get(depth, 0) + 1
        else:
            counters.pop(depth, None)
        marker = f"{counters[depth]}. " if block["ordered"] else "- "
        inset = " " * sum(widths)
        widths.append(len(marker))
        return inset + marker + text
    widths.clear()
    counters.clear()
    if kind == "heading":
        return "#" * block["level"] + " " + text
    if kind == "quote":
        return "> " + text.replace("\n", "\n> ")
    if kind == "code":
        longest = max((len(run) for run in re.findall("`+", text)), default=0)
        fence = "`" * max(3, longest + 1)
        return "\n".join((fence + block["info"], text, fence))
    if kind == "table":
        shown = ["| " + " | ".join(_CELL_END.sub(r"\\|", c) for c in row) + " |" for row in block["rows"]]
        return "\n".join([shown[0], "|" + "---|" * len(block["rows"][0]), *shown[1:]])
    return "---" if kind == "page_break" else text


def written(blocks: list[dict]) -> str:
    """Blocks of one document as canonical Markdown."""
    out: list[str] = []
    widths: list[int] = []
    counters: dict[int, int] = {}
    for before, block in zip([None, *blocks], blocks, strict=False):
        piece = _piece(block, widths, counters)
        if before is None:
            out.append(piece)
            continue
        both = {before["kind"], block["kind"]}
        if both == {"list_item"}:
            out.append("\n\n" if block["depth"] == 0 and block["ordered"] != before["ordered"] else "\n")
        else:
            out.append("\n>\n" if both == {"quote"} else "\n\n")
        out.append(piece)
    return "".join(out) + "\n" if out else ""


def markdown_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, md: every document's blocks as canonical Markdown. A document is one row, never more than a document."""
    columns = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")][1:]
    rows = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("blocks"))

    schema = pa.schema([("doc_id", pa.int64()), ("md", pa.string())])

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((i.as_py(), written(own.as_py())) for batch in batches for i, own in zip(batch.column(0), batch.column(1), strict=True))
        return _gathered(((len(md), {"doc_id": i, "md": md}) for i, md in texts), schema)

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "blocks").mapInArrow(shown, "doc_id bigint, md string")


def same_shape(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, same: whether two tables of blocks agree in kinds, levels, depths, list kinds and cells of each row."""

    def shape(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", "block_idx", F.struct("kind", "level", "depth", "ordered", F.transform("rows", F.size).alias("cells")).alias(name))

    both = shape(left, "a").join(shape(right, "b"), ["doc_id", "block_idx"], "full")
    return both.groupBy("doc_id").agg(F.every(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
