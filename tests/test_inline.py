"""Inline Markdown: formats, nesting, delimiters that pair or stay, links, images, code and breaks."""

import pytest
from pyspark.sql import functions as F

from termweave.functions import inline

CASES = {
    "Hallo Welt": [("Hallo Welt", "", "")],
    "a **b *c*** d": [("a ", "", ""), ("b ", "b", ""), ("c", "bi", ""), (" d", "", "")],
    r"`x` [Seite](https://a.example) \*kein\*": [("x", "c", ""), (" ", "", ""), ("Seite", "", "https://a.example"), (" *kein*", "", "")],
    "eins\nzwei  \ndrei ![Logo](l.png)": [("eins zwei\ndrei [Bild: Logo]", "", "")],
    "***a** b*": [("a", "bi", ""), (" b", "i", "")],
    "*a **b***": [("a ", "i", ""), ("b", "bi", "")],
    "_a_b_ __c__ snake_case_word": [("a_b", "i", ""), (" ", "", ""), ("c", "b", ""), (" snake_case_word", "", "")],
    "**a*": [("*", "", ""), ("a", "i", "")],
    "a ** b ** c": [("a ** b ** c", "", "")],
    "*foo**bar*": [("foo**bar", "i", "")],
    "**foo*bar**": [("foo*bar", "b", "")],
    "[a *b](u) c*": [("a *b", "", "u"), (" c*", "", "")],
    "*[foo*](url)": [("*", "", ""), ("foo*", "", "url")],
    "*a [b **c**](u)*": [("a ", "i", ""), ("b ", "i", "u"), ("c", "bi", "u")],
    "[![im](a.png)](b.html)": [("[Bild: im]", "", "b.html")],
    "`` a`b `` `c": [("a`b", "c", ""), (" `c", "", "")],
    "` `` ` `a\nb`": [("``", "c", ""), (" ", "", ""), ("a b", "c", "")],
    "<https://x.y/z> <a.b@c.de> <b>t</b> 1 < 2 & &lt;": [("https://x.y/z", "", "https://x.y/z"), (" ", "", ""), ("a.b@c.de", "", "mailto:a.b@c.de"), (" <b>t</b> 1 < 2 & <", "", "")],
    '[x](<a b> "t") [y]( ) [z][q] [p](a(b)c)': [("x", "", "a b"), (" y [z][q] ", "", ""), ("p", "", "a(b)c")],
    "[a [b](c) d](e)": [("[a ", "", ""), ("b", "", "c"), (" d](e)", "", "")],
    "****a****": [("a", "b", "")],
    "*a*b **c**d foo***": [("a", "i", ""), ("b ", "", ""), ("c", "b", ""), ("d foo***", "", "")],
    "a\\\nb": [("a\nb", "", "")],
    "*(**foo**)*": [("(", "i", ""), ("foo", "bi", ""), (")", "i", "")],
    "": [],
    None: None,
    "wort " * 20_000: [("wort " * 20_000, "", "")],
    # longer than the blocks in which tokens look for links and spans
    "**" + "a *b* " * 200 + "c** d": [("a ", "b", "")] + [(x, f, "") for k in range(200) for x, f in (("b", "bi"), (" a " if k < 199 else " c", "b"))] + [(" d", "", "")],
    "[x " + "*y* " * 150 + "](u)": [("x ", "", "u")] + [(x, f, "u") for _ in range(150) for x, f in (("y", "i"), (" ", ""))],
    "![" + r"\* " * 150 + "z](u)": [("[Bild: " + r"\* " * 150 + "z]", "", "")],
    "[a](" + "x" * 50_000 + ")": [("a", "", "x" * 50_000)],
}


def test_runs(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string").coalesce(1).select("i", inline.runs(F.col("t")).alias("runs")).collect()
    flags = lambda r: "b" * r.bold + "i" * r.italic + "c" * r.code
    got = {r.i: r.runs if r.runs is None else [(x.text, flags(x), x.href) for x in r.runs] for r in rows}
    for i, (text, expected) in enumerate(CASES.items()):
        assert got[i] == expected, text and text[:80]


@pytest.mark.parametrize("text", ["a", "**x**"])
def test_no_worker(spark, text):
    plan = spark.range(1).select(inline.runs(F.concat(F.lit(text), F.col("id").cast("string"))).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
