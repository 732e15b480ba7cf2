"""Inline Markdown as runs of one format, by folds over an array of tokens within a row.

A text is cut into tokens by one pattern. A first fold pairs brackets to links and images, a second one pairs delimiter
runs to emphasis by the rules of CommonMark; then each token knows what it stands in. No Python worker takes part.
Links by reference, entities but for the five of XML, and the encoding of addresses are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCT = r"[\p{P}$+<=>^`|~]"
# loops are unrolled, so that long addresses and titles don't nest the matcher's calls
_PARENS = r"\([^\s()\\]*(?:\\.[^\s()\\]*)*\)"
_ADDRESS = rf"\s*(?:<[^<>\n]*>|(?!<)[^\s()\\]*(?:(?:\\.|{_PARENS})[^\s()\\]*)*)"
_TITLE = r"""(?:\s+(?:"[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|\([^()\\]*(?:\\.[^()\\]*)*\)))?\s*"""
_TOKENS = {
    "code": r"(?<!`)(`+)(?!`)[\s\S]*?(?<!`)\1(?!`)",
    "ticks": r"`+",
    "hard": r"(?: {2,}|\\)\n *",
    "soft": r" ?\n *",
    "escape": r"\\[!-/:-@\[-`{-~]",
    "auto": r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>",
    "html": r"""</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|<!--[\s\S]*?-->""",
    "link": rf"\]\({_ADDRESS}{_TITLE}\)",
    "image": r"!\[",
    "open": r"\[",
    "close": r"\]",
    "stars": r"\*+",
    "bars": r"_+",
    "text": r"[^`\\<!\[\]*_\n]+?(?= {2,}\n| ?\n|[`\\<!\[\]*_]|\z)|[\s\S]",
}
_ALL = "|".join(f"(?<{kind}>{pattern})" for kind, pattern in _TOKENS.items() if kind != "code")
# the code span's own group has to be the first, for its back reference
_PATTERN = f"(?:{_TOKENS['code']})|{_ALL}"
#: Tokens that look together for the links and spans that reach them.
_BLOCK = 64


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(token: Column) -> Column:
    first = F.left(token, F.lit(1))
    return (
        F.when(~first.isin("`", "\\", "<", "!", "[", "]", "*", "_", "\n", " "), "text")
        .when(token.rlike(r"\A`+\z"), "ticks")
        .when(first == "`", "code")
        .when(token.rlike(r"\A(?: {2,}|\\)\n"), "hard")
        .when(token.rlike(r"\A ?\n"), "soft")
        .when(token.rlike(r"\A\\[!-/:-@\[-`{-~]\z"), "escape")
        .when(token.rlike(rf"\A{_TOKENS['auto']}\z"), "auto")
        .when(token.rlike(r"\A\]\("), "link")
        .when(token == "![", "image")
        .when(token == "[", "open")
        .when(token.rlike(r"\A[*_]+\z"), "run")
        .otherwise("text")
    )


def _links(tokens: Column) -> Column:
    """Pairs (from, to, image) of brackets that are links or images; a link in a link is none, the inner one stays."""
    pairs = "array<struct<from int, to int, image boolean>>"
    start = F.struct(F.array().cast("array<struct<at int, image boolean, active boolean>>").alias("open"), F.array().cast(pairs).alias("links"))

    def step(acc: Column, t: Column) -> Column:
        opener = F.struct(t["at"].alias("at"), (t["kind"] == "image").alias("image"), F.lit(True).alias("active"))
        last, rest = F.try_element_at(acc["open"], F.lit(-1)), F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        outer = F.when(last["image"], rest).otherwise(F.transform(rest, lambda o: F.struct(o["at"].alias("at"), o["image"].alias("image"), o["image"].alias("active"))))
        pair = F.array(F.struct(last["at"].alias("from"), t["at"].alias("to"), last["image"].alias("image")))
        ends = t["kind"].isin("link", "close")
        return (
            F.when(t["kind"].isin("open", "image"), F.struct(F.concat(acc["open"], F.array(opener)).alias("open"), acc["links"].alias("links")))
            .when((t["kind"] == "link") & F.coalesce(last["active"], F.lit(False)), F.struct(outer.alias("open"), F.concat(acc["links"], pair).alias("links")))
            .when(ends, F.struct(rest.alias("open"), acc["links"].alias("links")))
            .otherwise(acc)
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["links"])


def _emphasis(tokens: Column, links: Column) -> Column:
    """Spans (from, to, n) of delimiter runs: n is 2 for strong, 1 for emphasis."""
    openers = "array<struct<at int, ch string, n int, whole int, closes boolean>>"
    start = F.struct(F.array().cast(openers).alias("open"), F.array().cast("array<struct<from int, to int, n int>>").alias("spans"), F.lit(0).alias("left"))

    def match(t: Column, floor: Column):
        def step(acc: Column, _: Column) -> Column:
            odd = lambda o: (o["closes"] | t["opens"]) & ((o["whole"] + t["whole"]) % 3 == 0) & ~((o["whole"] % 3 == 0) & (t["whole"] % 3 == 0))
            fits = lambda o: (o["ch"] == t["ch"]) & (o["at"] > floor) & ~odd(o)
            found = F.when(acc["left"] > 0, F.try_element_at(F.filter(acc["open"], fits), F.lit(-1)))
            return _let(found, lambda opener: F.when(opener.isNotNull(), paired(acc, opener)).otherwise(acc))

        def paired(acc: Column, opener: Column) -> Column:
            n = F.when((opener["n"] >= 2) & (acc["left"] >= 2), 2).otherwise(1)
            kept = F.filter(acc["open"], lambda o: o["at"] < opener["at"])
            shorter = F.struct(opener["at"].alias("at"), opener["ch"].alias("ch"), (opener["n"] - n).alias("n"), opener["whole"].alias("whole"), opener["closes"].alias("closes"))
            after = F.when(opener["n"] > n, F.concat(kept, F.array(shorter))).otherwise(kept)
            span = F.array(F.struct(opener["at"].alias("from"), t["at"].alias("to"), n.alias("n")))
            return F.struct(after.alias("open"), F.concat(acc["spans"], span).alias("spans"), (acc["left"] - n).alias("left"))

        return step

    def step(acc: Column, t: Column) -> Column:
        inside = F.filter(links, lambda x: (x["from"] < t["at"]) & (t["at"] < x["to"]))
        floor = F.coalesce(F.array_max(F.transform(inside, lambda x: x["from"])), F.lit(-1))
        fresh = F.struct(acc["open"].alias("open"), acc["spans"].alias("spans"), t["whole"].alias("left"))
        closed = F.when(t["closes"] & (F.size(acc["open"]) > 0), _let(floor, lambda floor: F.aggregate(F.sequence(F.lit(1), t["whole"]), fresh, match(t, floor)))).otherwise(fresh)
        opener = lambda c: F.struct(t["at"].alias("at"), t["ch"].alias("ch"), c["left"].alias("n"), t["whole"].alias("whole"), t["closes"].alias("closes"))
        opened = _let(closed, lambda c: F.struct(F.when(t["opens"] & (c["left"] > 0), F.concat(c["open"], F.array(opener(c)))).otherwise(c["open"]).alias("open"), c["spans"].alias("spans"), c["left"].alias("left")))
        # what a link holds pairs with nothing after it
        ended = F.array_max(F.transform(F.filter(links, lambda x: x["to"] == t["at"]), lambda x: x["from"]))
        dropped = F.struct(F.filter(acc["open"], lambda o: o["at"] < ended).alias("open"), acc["spans"].alias("spans"), acc["left"].alias("left"))
        # only such tokens end a link
        return F.when(t["kind"] == "run", opened).when((t["kind"] == "link") & (F.size(acc["open"]) > 0), F.when(ended.isNotNull(), dropped).otherwise(acc)).otherwise(acc)

    return F.aggregate(tokens, start, step, lambda acc: acc["spans"])


def _tokens(text: Column) -> Column:
    """at, raw, kind of each token; of delimiter runs ch, whole (their length), opens and closes, too."""

    def described(raw: Column) -> Column:
        def one(token: Column, at: Column) -> Column:
            before, after = F.right(F.when(at > 0, F.get(raw, at - 1)).otherwise(" "), F.lit(1)), F.left(F.coalesce(F.get(raw, at + 1), F.lit(" ")), F.lit(1))
            space, mark = lambda c: c.rlike(r"(?U)\s"), lambda c: c.rlike(_PUNCT)
            left = ~space(after) & (~mark(after) | space(before) | mark(before))
            right = ~space(before) & (~mark(before) | space(after) | mark(after))
            star = F.left(token, F.lit(1)) == "*"
            opens, closes = F.when(star, left).otherwise(left & (~right | mark(before))), F.when(star, right).otherwise(right & (~left | mark(after)))

            def known(kind: Column) -> Column:
                run = kind == "run"
                return F.struct(
                    at.alias("at"),
                    token.alias("raw"),
                    kind.alias("kind"),
                    F.left(token, F.lit(1)).alias("ch"),
                    F.length(token).alias("whole"),
                    (run & opens).alias("opens"),
                    (run & closes).alias("closes"),
                )

            return _let(_kind(token), known)

        return F.transform(raw, one)

    return _let(F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0)), described)


def _shown(t: Column) -> Column:
    """What a token that is no delimiter shows as."""
    ticks = F.length(F.regexp_extract(t["raw"], "^`+", 0))
    inner = F.translate(F.substring(t["raw"], ticks + 1, F.length(t["raw"]) - 2 * ticks), "\n", " ")
    code = F.when(inner.rlike(r"\A [\s\S]* \z") & inner.rlike("[^ ]"), F.substring(inner, F.lit(2), F.length(inner) - 2)).otherwise(inner)
    plain = t["raw"]
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(mark))
    return (
        F.when(t["kind"] == "code", code)
        .when(t["kind"] == "hard", "\n")
        .when(t["kind"] == "soft", " ")
        .when(t["kind"] == "escape", F.right(t["raw"], F.lit(1)))
        .when(t["kind"] == "auto", F.substring(t["raw"], F.lit(2), F.length(t["raw"]) - 2))
        .when(t["kind"] == "text", plain)
        .otherwise(t["raw"])
    )


def _address(raw: Column) -> Column:
    """The address of a token ``](address "title")``."""
    inner = F.regexp_extract(raw, rf"\A\]\(({_ADDRESS}){_TITLE}\)\z", 1)
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(inner, r"\s", " ")), r"\A<([\s\S]*)>\z", "$1"), r"\\([!-/:-@\[-`{-~])", "$1")


def runs(text: Column) -> Column:
    """Runs (text, bold, italic, code, href) of a Markdown text in order; neighbours of one format are one run.

    Soft breaks are a space, hard ones \\n; an image is ``[Bild: alt]``; href is empty outside links. Null stays null, an
    empty text has no runs.
    """
    none = F.array().cast("array<struct<text string, bold boolean, italic boolean, code boolean, href string>>")

    def built(tokens: Column, links: Column, spans: Column) -> Column:
        def piece(t: Column, links: Column, spans: Column) -> Column:
            around = F.filter(links, lambda x: (x["from"] < t["at"]) & (t["at"] < x["to"]))
            ends = F.get(F.filter(links, lambda x: x["to"] == t["at"]), F.lit(0))
            return _let(around, lambda around: _let(ends, lambda ends: shaped(t, links, spans, around, ends)))

        def shaped(t: Column, links: Column, spans: Column, around: Column, ends: Column) -> Column:
            covers = lambda s: (s["from"] < t["at"]) & (t["at"] < s["to"])
            used = F.aggregate(F.filter(spans, lambda s: (s["from"] == t["at"]) | (s["to"] == t["at"])), F.lit(0), lambda n, s: n + s["n"])
            starts = F.exists(links, lambda x: x["from"] == t["at"])
            alt = F.array_join(F.transform(F.slice(tokens, ends["from"] + 2, t["at"] - ends["from"] - 1), lambda x: x["raw"]), "")
            outer = F.get(F.filter(around, lambda x: ~x["image"]), F.lit(0))
            shown = (
                F.when(F.exists(around, lambda x: x["image"]) | starts, "")
                .when(ends["image"], F.concat(F.lit("[Bild: "), alt, F.lit("]")))
                .when(ends.isNotNull(), "")
                .when(t["kind"] == "run", F.repeat(t["ch"], t["whole"] - used))
                .otherwise(_shown(t))
            )
            mail = ~F.contains(t["raw"], F.lit(":")) | t["raw"].rlike("^<[^:]*@")
            own = F.concat(F.when(mail, "mailto:").otherwise(""), _shown(t))
            address = lambda outer: F.when(outer.isNotNull(), _address(F.get(tokens, outer["to"])["raw"])).when(t["kind"] == "auto", own).otherwise("")
            inside = lambda n: F.exists(spans, lambda s: covers(s) & (s["n"] == n))
            return F.struct(shown.alias("text"), inside(2).alias("bold"), inside(1).alias("italic"), (t["kind"] == "code").alias("code"), _let(outer, address).alias("href"))

        def block(start: Column) -> Column:
            near = lambda pairs: F.filter(pairs, lambda x: (x["from"] < start + _BLOCK) & (x["to"] >= start))
            return _let(near(links), lambda ls: _let(near(spans), lambda ss: F.transform(F.slice(tokens, start + 1, F.lit(_BLOCK)), lambda t: piece(t, ls, ss))))

        def join(acc: Column, p: Column) -> Column:
            last, init = F.try_element_at(acc, F.lit(-1)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            alike = (last["bold"] == p["bold"]) & (last["italic"] == p["italic"]) & (last["code"] == p["code"]) & (last["href"] == p["href"])
            longer = F.struct(F.concat(last["text"], p["text"]).alias("text"), p["bold"].alias("bold"), p["italic"].alias("italic"), p["code"].alias("code"), p["href"].alias("href"))
            return F.when(p["text"] == "", acc).when(F.coalesce(alike, F.lit(False)), F.concat(init, F.array(longer))).otherwise(F.concat(acc, F.array(p)))

        def append(acc: Column, own: Column) -> Column:
            return F.when(F.size(own) == 0, acc).otherwise(F.concat(join(acc, F.get(own, F.lit(0))), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))))

        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(_BLOCK))
        return F.aggregate(F.transform(starts, lambda start: F.aggregate(block(start), none, join)), none, append)

    return _let(_tokens(text), lambda ts: _let(_links(ts), lambda ls: _let(_emphasis(ts, ls), lambda ss: built(ts, ls, ss))))
