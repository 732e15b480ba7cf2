"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: formatting tags of translated runs.
TAG = r"</?(?:a[0-9]+|b|i|u)>"
# Units that a number keeps.
UNITS = (
    "mm", "cm", "km", "m", "kg", "mg", "µg", "g", "ml", "l", "%", "°C", "°", "Bq", "kBq", "MBq", "Sv", "mSv", "µSv", "Gy", "mGy",
    "kW", "MW", "W", "kV", "V", "mA", "A", "Hz", "kHz", "MHz", "h", "min", "s",
)
# Patterns of what a translation must keep: code, footnotes, addresses, placeholders, measures.
PROTECTED = "(?U)" + "|".join(
    (
        r"`[^`\n]+`",
        r"\[\^[^\]\s]+\]",
        r"https?://[^\s)>\]]*[^\s)>\].,;:!?]",
        # from the start of a run only, or from where the last find ended: a later start finds nothing that this one doesn't
        r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]+(?:\.[\w-]+)+",
        r"\{[^{}\s]*\}",
        r"\d+(?:[.,]\d+)?\s?(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![A-Za-zµ])",
    )
)
# Fixed value: a pattern without which no text has any of these.
_MAY_PROTECT = r"[`@{\p{Nd}]|\[\^|://"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once, also where a lambda uses it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def casefolded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def slug(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "-")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def clean_answer(text: Column) -> Column:
    """A model's answer without its thinking and outer white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def protected(text: Column, start: Column | None = None) -> tuple[Column, Column]:
    """Text with its protected spans as tokens ⟦Pn⟧, numbered from ``start``, and the spans in order."""
    plain = ~text.rlike(_MAY_PROTECT)
    spans = F.when(plain, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0)))
    pieces = F.split(text, PROTECTED, -1)
    first = F.lit(1) if start is None else start
    masked = F.when(plain, text).otherwise(F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("⟦P"), (i + first - 1).cast("string"), F.lit("⟧"), p))), ""))
    return masked, spans


def restored(text: Column, spans: Column, start: Column | None = None) -> Column:
    """The text with every token replaced by its span; unknown tokens stay."""
    first = F.lit(1) if start is None else start
    numbered = F.transform(spans, lambda s, i: F.struct((i + first).cast("string").alias("n"), s.alias("s")))
    return F.aggregate(numbered, text, lambda acc, x: F.replace(acc, F.concat(F.lit("⟦P"), x["n"], F.lit("⟧")), x["s"]))


def sentences(text: Column) -> Column:
    """Sentences of a text, cut after . ! ? and white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def tags_balanced(text: Column) -> Column:
    """Whether tags close in the order in which they opened, by a fold over them with a stack."""
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    name = lambda t: F.regexp_replace(t, "[</>]", "")

    def step(acc: Column, tag: Column) -> Column:
        closes = F.startswith(tag, F.lit("</"))
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.array_contains(acc, "!"), acc).when(~closes, F.concat(acc, F.array(name(tag)))).when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == name(tag)), popped).otherwise(F.array(F.lit("!")))

    return F.size(F.aggregate(tags, F.array().cast("array<string>"), step)) == 0


def opening_tags(text: Column) -> Column:
    """Names of a text's opening tags, sorted, with repeats."""
    return F.array_sort(F.regexp_extract_all(text, F.lit("<(a[0-9]+|b|i|u)>"), F.lit(1)))


def tag_pieces(text: Column, expected: Column) -> Column:
    """A tagged text's pieces (text, bold, italic, underline, link) in order, empty ones left out.

    Null where tags don't close in order, or where the opening ones aren't those ``expected`` (as ``opening_tags`` gives).
    """
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), F.array(none).alias("seen"), F.lit(True).alias("ok"))

    def step(acc: Column, tag: Column) -> Column:
        name, closes = F.regexp_replace(tag, "[</>]", ""), F.startswith(tag, F.lit("</"))
        rest = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        after = F.when(closes, rest).otherwise(F.concat(acc["open"], F.array(name)))
        ok = acc["ok"] & (~closes | F.coalesce(F.try_element_at(acc["open"], F.lit(-1)) == name, F.lit(False)))
        return F.struct(after.alias("open"), F.concat(acc["seen"], F.array(after)).alias("seen"), ok.alias("ok"))

    def piece(part: Column, names: Column) -> Column:
        link = F.get(F.filter(names, lambda n: F.startswith(n, F.lit("a"))), F.lit(0))
        has = lambda n: F.array_contains(names, n)
        return F.struct(part.alias("text"), has("b").alias("bold"), has("i").alias("italic"), has("u").alias("underline"), F.coalesce(F.substring(link, 2, 9).cast("int"), F.lit(0)).alias("link"))

    def pieces(acc: Column) -> Column:
        found = F.filter(F.zip_with(F.split(text, TAG, -1), acc["seen"], piece), lambda p: p["text"] != "")
        return F.when(acc["ok"] & (F.size(acc["open"]) == 0) & (opening_tags(text) == expected), found)

    return F.get(F.transform(F.array(F.aggregate(tags, start, step)), pieces), F.lit(0))


def emphasised(text: Column, bold: Column, italic: Column) -> Column:
    """Text between Markdown's stars, white space around it left outside; blank and plain texts as they are."""
    stars = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
    inner = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    marked = F.concat(F.regexp_extract(text, r"(?U)^\s*", 0), stars, inner, stars, F.regexp_extract(text, r"(?U)\s*\z", 0))
    return F.when((inner == "") | (stars == ""), text).otherwise(marked)


def escaped(text: Column) -> Column:
    """Text for XML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def run_markup(run: Column, mono: str = "Mono", color: str = "#0563C1") -> Column:
    """A run (text, bold, italic, code, href) as a page's markup."""
    out = F.replace(escaped(run["text"]), F.lit("\n"), F.lit("<br/>"))
    out = F.when(run["code"], F.concat(F.lit(f'<font face="{mono}">'), out, F.lit("</font>"))).otherwise(out)
    for flag, tag in (("bold", "b"), ("italic", "i")):
        out = F.when(run[flag], F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    href = F.replace(escaped(run["href"]), F.lit('"'), F.lit("&quot;"))
    return F.when(run["href"] != "", F.concat(F.lit('<a href="'), href, F.lit(f'" color="{color}">'), out, F.lit("</a>"))).otherwise(out)


def stars(n: Column) -> Column:
    """A rating of three."""
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 3 - n))
