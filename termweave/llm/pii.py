"""Surrogates for personal data: keyed, of the same type and format, distinct and the same for every mention.

DataFrame functions only. One pattern finds all mentions; each mention has one or more parts (given names and surnames of
a name), and a part is an entity of a type with a normal form (e-mail in lower case, digits of a number). Over the
whole corpus each entity gets one surrogate, drawn by a keyed hash, so all its mentions still name one thing. Surrogates
that two entities of a type share, or that equal an entity of the corpus, are drawn again until none is left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

# Titles that introduce a name, by the gender that they tell (n: none).
TITLES = {
    "m": ("Mr", "Mister", "Herrn", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Signor", "господин", "г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "госпожа", "г-жа", "Κυρία"),
    "n": ("Doctor", "Dr", "Professor", "Prof", "Docteur", "Doktor"),
}
# Greetings after which two words with capitals are a name.
GREETINGS = ("Dear", "Hello", "Hi", "Liebe", "Lieber", "Cher", "Chère", "Querido", "Querida")
# Patterns of the types, in the order in which they are tried at a place.
_WORD = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)*"
_TITLE = rf"(?:{'|'.join(t for some in TITLES.values() for t in some)})\.?"
_LEAD = rf"(?:{_TITLE} )+"
_NAME = rf"(?<![\p{{L}}\p{{N}}-])(?:{_LEAD}(?!{_TITLE} ){_WORD}(?: {_WORD})?|(?:{'|'.join(GREETINGS)}) (?!{_TITLE}[ ,]){_WORD} {_WORD})"
PATTERNS = {
    "name": _NAME,
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "password": r"(?i:password|passwd|pwd)=[^\s\"']+",
    "token": r"(?i:token|secret|api_key|apikey) ?= ?\"[^\s\"]+\"",
    "accesskey": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\w|\.[0-9])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\w])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap tests that hold for every text with a name, or with any mention.
_MAYBE_NAME = rf"(?:{'|'.join(t for some in TITLES.values() for t in some)}|{'|'.join(GREETINGS)})\.? \p{{Lu}}"
_MAYBE = rf"[0-9@=]|{_MAYBE_NAME}"
#: Draws after which a surrogate may get longer than the original, where a format has no free values left.
_DRAWS_IN_FORMAT = 8
#: Endings of names in the scripts that surrogates keep; a stem of three syllables stands before them.
_ENDINGS = r"(?:na|n|r|на|н|ва|в|να|ν|ρ)$"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out and stands in the plan once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _name_of(mention: Column) -> Column:
    """A mention's name without titles and greeting."""
    return F.regexp_replace(mention, rf"^(?:{_LEAD}|(?:{'|'.join(GREETINGS)}) )", "")


def _lead_of(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^(?:{_LEAD}|(?:{'|'.join(GREETINGS)}) )", 0)


def _gender(mention: Column) -> Column:
    told = {g: rf"^(?:{_TITLE} )*(?:{'|'.join(TITLES[g])})\.? " for g in "fm"}
    return F.when(mention.rlike(told["f"]), "f").when(mention.rlike(told["m"]), "m").otherwise("n")


def _part(kind: Column, norm: Column, shown: Column, gender: Column) -> Column:
    return F.struct(kind.alias("type"), norm.alias("norm"), shown.alias("shown"), gender.alias("gender"))


def _name_norm(word: Column, gender: Column) -> Column:
    """Lower case; a female Cyrillic surname counts as its male form, so that a family keeps one name."""
    return F.when(gender == "f", F.regexp_replace(F.lower(word), "(ов|ев|ин)а$", "$1")).otherwise(F.lower(word))


def _name_parts(mention: Column) -> Column:
    """Given names and surnames of a name with title: with two words the first is given; hyphens part a word."""

    def of_words(words: Column, gender: Column) -> Column:
        def of_word(word: Column, i: Column) -> Column:
            kind = F.when((F.size(words) > 1) & (i == 0), "given").otherwise("surname")
            return F.transform(F.split(word, "-"), lambda w: _part(kind, F.when(kind == "surname", _name_norm(w, gender)).otherwise(F.lower(w)), w, gender))

        return F.flatten(F.transform(words, of_word))

    return _let(F.split(_name_of(mention), " "), lambda words: _let(_gender(mention), lambda gender: of_words(words, gender)))


def _names(text: Column) -> Column:
    """The parts of all names that a title or greeting introduces in a text."""
    found = F.when(text.rlike(_MAYBE_NAME), F.regexp_extract_all(text, F.lit(_NAME), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(found), _name_parts)))


def _pattern(names: Column) -> Column:
    """The pattern of a text's mentions: all types, and its known names (three letters or more) without a title."""
    long = F.array_distinct(F.transform(F.filter(names, lambda n: F.length(n["shown"]) > 2), lambda n: n["shown"]))
    several = lambda one: F.concat(F.lit(rf"{_ANY}|(?<![\p{{L}}\p{{N}}-])"), one, F.lit("(?:[ -]"), one, F.lit(r")*(?![\p{L}\p{N}])"))
    return _let(F.array_join(long, "|"), lambda found: F.when(found != "", several(F.concat(F.lit("(?:"), found, F.lit(")")))).otherwise(F.lit(_ANY)))


def mentions(text: Column, pattern: Column) -> Column:
    """All mentions of a text, in order."""
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))


def _type_of(mention: Column) -> Column:
    kind = F
    for name, pattern in PATTERNS.items():
        kind = kind.when(mention.rlike(f"^(?:{pattern})$"), name)
    return kind.otherwise("known")


def parts(mention: Column, names: Column) -> Column:
    """A mention's parts in order: type, norm (normal form), shown (as it stands there) and gender.

    ``names`` are the parts of the text's names; they tell what a name without title is.
    """
    return _let(_type_of(mention), lambda kind: _parts_of(mention, names, kind))


def _parts_of(mention: Column, names: Column, kind: Column) -> Column:
    def known(word: Column) -> Column:
        same = F.filter(names, lambda n: n["shown"] == word)
        surname = lambda found: F.get(F.filter(found, lambda n: n["type"] == "surname"), F.lit(0))
        return _let(same, lambda found: F.coalesce(surname(found), F.get(found, F.lit(0))))

    value = F.when(kind == "password", F.regexp_extract(mention, "=(.*)$", 1)).when(kind == "token", F.regexp_extract(mention, '"(.*)"', 1)).otherwise(mention)
    norm = (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9+]", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(value)
    )
    return F.when(kind == "name", _name_parts(mention)).when(kind == "known", F.transform(F.split(mention, "[ -]"), known)).otherwise(F.array(_part(kind, norm, value, F.lit("n"))))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th of 128 bytes, from 0, of a hexadecimal stream."""
    return F.conv(F.substr(stream, 2 * F.pmod(i, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: str, n: Column) -> Column:
    return F.substr(F.lit(options), F.pmod(n, F.lit(len(options))) + 1, F.lit(1))


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits; a multiple of 10 for valid ones."""
    size = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(size - i, F.lit(2)) == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x))


def _hmac(message: Column, key: str) -> Column:
    """HMAC-SHA-256 in hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _syllables(stream: Column, consonants: str, vowels: str, count: int) -> Column:
    return F.concat(*[_pick(consonants if k % 2 == 0 else vowels, _byte(stream, F.lit(k))) for k in range(2 * count)])


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form: characters replaced within their class, types' fixed parts kept."""
    seed = F.concat_ws("\x1f", kind, norm, attempt.cast("string"))
    stream = F.concat(*[_hmac(F.concat_ws("\x1f", seed, F.lit(str(k))), key) for k in range(4)])
    return _let(stream, lambda bytes_: _drawn(kind, norm, attempt, bytes_))


def _drawn(kind: Column, norm: Column, attempt: Column, stream: Column) -> Column:
    """The surrogate that a stream of bytes draws."""
    size = F.length(norm)
    head = F.when(kind == "phone", F.when(norm.startswith("+"), 2).otherwise(0)).when(kind == "card", 1).when(kind == "accesskey", 4).when(kind == "iban", 2).otherwise(0)
    tail = F.when(kind == "email", F.length(F.regexp_extract(norm, r"\.[^.]*$", 0))).otherwise(0)
    is_hex = norm.rlike("^[0-9a-f]+$")

    def replaced(i: Column) -> Column:
        return _let(F.substr(norm, i, F.lit(1)), lambda c: _let(_byte(stream, i), lambda b: other(i, c, b)))

    def other(i: Column, c: Column, b: Column) -> Column:
        letter = F.when(is_hex, _pick("abcdef", b)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", b))
        digit = F.when(kind == "accesskey", _pick("234567", b)).when((kind == "phone") & (i == head + 1), _pick("23456789", b)).otherwise(_pick("0123456789", b))
        return F.when((i <= head) | (i > size - tail), c).when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).otherwise(c)

    chars = F.array_join(F.transform(F.sequence(F.lit(1), size), replaced), "")

    def card(chars: Column) -> Column:
        body = F.substr(chars, F.lit(1), size - 1)
        check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(_luhn_sum(norm), F.lit(10)) == 0, F.concat(body, check)).otherwise(chars)

    octets = F.transform(F.split(norm, r"\."), lambda o, i: F.when(F.length(o) == 1, 1 + F.pmod(_byte(stream, i), F.lit(9))).when(F.length(o) == 2, 10 + F.pmod(_byte(stream, i), F.lit(90))).otherwise(100 + F.pmod(_byte(stream, i), F.lit(155))).cast("string"))
    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    stem = F.when(cyrillic, _syllables(stream, "бвгдзклмнпрст", "аеиоу", 3)).when(norm.rlike(r"\p{IsGreek}"), _syllables(stream, "βγδζθκλμνπρτφ", "αειου", 3)).otherwise(_syllables(stream, "bdfgklmnprstv", "aeiou", 3))
    own = F.when(kind == "card", _let(chars, card)).when(kind == "ip", F.array_join(octets, ".")).when(kind.isin("given", "surname"), stem).otherwise(chars)
    return _let(own, lambda own: F.when(attempt < _DRAWS_IN_FORMAT, own).otherwise(_longer(kind, own, stream)))


def _longer(kind: Column, own: Column, stream: Column) -> Column:
    """A surrogate with more characters than its format has."""
    return F.when(kind.isin("phone", "card", "ssn", "ip"), F.concat(own, F.translate(F.substr(stream, F.lit(1), F.lit(6)), "abcdef", "012345"))).when(kind == "email", F.concat(F.substr(stream, F.lit(1), F.lit(8)), own)).when(kind.isin("given", "surname"), F.concat(own, F.translate(F.substr(stream, F.lit(1), F.lit(8)), "0123456789", "ghijklmnop"))).otherwise(F.concat(own, F.substr(stream, F.lit(1), F.lit(8))))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, norm, surrogate for distinct ``entities`` (type, norm): no two of a type alike, none an entity itself.

    Of entities that drew the same the one with the least norm keeps it; the others draw again. Each round settles
    nearly all, and from the ninth on surrogates may be longer, so rounds end.
    """
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.col("type").isin("given", "surname")
    known = entities.select("type", F.when(name, F.regexp_replace("norm", _ENDINGS, "")).otherwise(F.col("norm")).alias("surrogate"))
    # drawing is costly for so few bytes: as many tasks as there are, not as many as the bytes need
    open_, done, attempt = entities.repartition(parts, "type", "norm"), None, 0
    while True:
        drawn = open_.withColumn("surrogate", surrogate(F.col("type"), F.col("norm"), F.lit(attempt), key))
        taken = known if done is None else known.unionByName(done.select("type", "surrogate"))
        free = drawn.join(taken.withColumn("taken", F.lit(True)).distinct(), ["type", "surrogate"], "left")
        first = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("norm")) == 1
        judged = written(free.select("type", "norm", "surrogate", (first & F.col("taken").isNull()).alias("settled")), "surrogates")
        settled = judged.where("settled").drop("settled")
        done = settled if done is None else done.unionByName(settled)
        open_ = judged.where("not settled").select("type", "norm")
        attempt += 1
        if open_.isEmpty():
            return done


def _shown(part: Column, norm: Column) -> Column:
    """A surrogate's normal form as the mention had it: digits at its digits, spaces at its spaces, its upper case."""
    shown, kind = part["shown"], part["type"]
    spaced = kind.isin("phone", "card", "ssn", "iban")
    plain = F.replace(norm, F.lit("+"), F.lit(""))
    symbol = F.when(kind == "iban", "[^ ]").otherwise("[0-9]")

    def at(i: Column) -> Column:
        c = F.substr(shown, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(shown, F.lit(1), i), F.when(kind == "iban", " ").otherwise("[^0-9]"), F.lit("")))
        return F.when(F.regexp_like(c, symbol), F.substr(plain, nth, F.lit(1))).otherwise(c)

    symbols = F.length(F.regexp_replace(shown, F.when(kind == "iban", " ").otherwise("[^0-9]"), F.lit("")))
    laid = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(shown)), at), ""), F.substr(plain, symbols + 1, F.length(plain)))
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "c").when(norm.rlike(r"\p{IsGreek}"), "g").otherwise("l")
    female = part["gender"] == "f"

    def ending(latin: str, cyrillic: str, greek: str) -> Column:
        return F.when(script == "c", cyrillic).when(script == "g", greek).otherwise(latin)

    given = F.concat(norm, F.when(female, ending("na", "на", "να")).otherwise(ending("n", "н", "ν")))
    # only the Cyrillic surname tells a gender, and only where the original does
    surname = F.concat(norm, F.when(female & (F.lower(shown) != part["norm"]), "ва").otherwise(ending("r", "в", "ρ")))
    named = F.when(kind == "given", given).otherwise(surname)
    cased = F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: F.when(F.substr(shown, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substr(norm, i, F.lit(1)))).otherwise(F.substr(norm, i, F.lit(1))))
    name = _let(named, lambda named: F.when((shown == F.upper(shown)) & (F.length(shown) > 1), F.upper(named)).otherwise(F.initcap(named)))
    return F.when(spaced, laid).when(kind == "email", F.array_join(cased, "")).when(kind.isin("given", "surname"), name).otherwise(norm)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """Every row of ``docs`` with text replaced and n_mentions; all its other columns stay, whatever their names.

    ``docs`` needs doc_id and text; ``key`` is the secret of the surrogates. A name is found where a title or greeting
    introduces it, and then everywhere in that document, with or without title. A null text stays null and an empty one
    empty, with 0 mentions. Rows that repeat a doc_id, or have none, are told apart by their text. Texts without mentions
    are returned as they are. A column n_mentions of the input is replaced. An empty table gives no rows. Only a
    document's own surrogates travel to it, never the table of all.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # the row as one column: names of its columns meet none of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("string").alias("id"), F.col("text"), F.xxhash64("text").alias("hash"))
    marked = rows.withColumn("names", _names(text)).withColumn("pattern", _pattern(F.col("names"))).withColumn("mentions", mentions(text, F.col("pattern")))
    each = marked.select("id", "hash", "names", F.explode(F.array_distinct("mentions")).alias("mention"))
    found = written(each.select("id", "hash", F.explode(parts(F.col("mention"), F.col("names"))).alias("part")).select("id", "hash", F.col("part.type").alias("type"), F.col("part.norm").alias("norm")).distinct(), "entities")
    chosen = surrogates(found.select("type", "norm").distinct(), key)
    entry = F.struct(F.concat_ws("\x1f", "type", "norm").alias("k"), F.col("surrogate").alias("v"))
    books = found.join(chosen, ["type", "norm"]).groupBy(F.col("id").alias("of_id"), F.col("hash").alias("of_hash")).agg(F.map_from_entries(F.collect_set(entry)).alias("book"))
    joined = marked.join(books, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")

    def new(mention: Column) -> Column:
        value = lambda p: F.element_at(F.col("book"), F.concat_ws("\x1f", p["type"], p["norm"]))
        replaced = lambda kind: F.transform(_parts_of(mention, F.col("names"), kind), lambda p: _let(value(p), lambda norm: _shown(p, norm)))
        return _let(_type_of(mention), lambda kind: _let(replaced(kind), lambda shown: laid(mention, kind, shown)))

    def laid(mention: Column, kind: Column, replaced: Column) -> Column:
        one = F.get(replaced, F.lit(0))
        # between the parts of a name stand spaces and hyphens
        between = F.concat(F.regexp_extract_all(F.when(kind == "name", _name_of(mention)).otherwise(mention), F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
        name = F.array_join(F.zip_with(replaced, between, lambda a, b: F.concat(a, b)), "")
        return (
            F.when(kind.isin("name", "known"), F.concat(F.when(kind == "name", _lead_of(mention)).otherwise(""), name))
            .when(kind == "password", F.concat(F.regexp_extract(mention, "^[^=]*=", 0), one))
            .when(kind == "token", F.concat(F.regexp_extract(mention, '^[^"]*"', 0), one, F.lit('"')))
            .otherwise(one)
        )

    # a text is cut once
    replaced = lambda pieces: F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size("mentions")), F.transform("mentions", new), lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    text = F.when(F.size("mentions") == 0, F.col("text")).otherwise(_let(F.split("text", F.col("pattern"), -1), replaced))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_mentions"], F.size("mentions").alias("n_mentions"))
