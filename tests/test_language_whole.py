"""Language detection over the whole table, against plain counts."""

import math
import random
from collections import Counter

from termweave.operators import language
from termweave.plans import catalogue, translation

TABLES = "/root/testdata/sf0.001"


def grams(text):
    text = (text or "").lower()
    return [text[i : i + 3] for i in range(len(text) - 2)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in docs:
        counts.setdefault(r.lang, Counter()).update(grams(r.text))
    got = {(r.lang, r.gram): r.n for r in catalogue.QUERIES["lang_profiles_whole"](spark, TABLES).collect()}
    assert got == {(lang, g): n for lang, c in counts.items() for g, n in c.items()}

    size = len(set().union(*counts.values()))
    totals = {lang: c.total() for lang, c in counts.items()}

    def best(text):
        scores = {lang: sum(math.log((c[g] + 0.5) / (totals[lang] + size / 2)) for g in grams(text)) for lang, c in counts.items()}
        return min(scores, key=lambda lang: (-round(scores[lang], 6), lang)) if grams(text) else None

    found = {r.doc_id: r.lang for r in catalogue.QUERIES["lang_detect_whole"](spark, TABLES).collect()}
    assert found == {r.doc_id: best((r.text or "")[:2000]) for r in docs}
    foreign = {r.doc_id for r in translation.QUERIES["skip_target_language_whole"](spark, TABLES).collect()}
    assert foreign == {r.doc_id for r in docs if len(r.text or "") >= 40 and best(r.text) != "en"}
    assert any(i % 2 == 0 for i in foreign)


def test_every_row_by_itself(spark, monkeypatch):
    """Null and repeated ids, empty and long texts: each row is judged by its own text, by a sent table or by a join."""
    rng = random.Random(4)
    words = {"de": ["der", "die", "und", "nicht", "straße", "übung"], "en": ["the", "and", "not", "street", "which", "thing"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(1, say("de", 30)), (1, say("en", 30)), (None, say("de", 30)), (None, say("en", 30)), (2, ""), (3, None), (4, "ab"), (5, say("en", 9) + say("de", 400_000)), (6, "漢字漢字漢字漢字"), (7, "abc")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, lang int")
    known = spark.createDataFrame([(lang, say(lang, 200)) for lang in words] + [(None, say("de", 5)), ("en", None)], "lang string, text string")
    counts = language.gram_counts(known)
    expected = Counter((lang, text.lower()[i : i + 3]) for lang, text in [(r.lang, r.text or "") for r in known.collect()] if lang for i in range(len(text) - 2))
    assert {(r.lang, r.gram): r.n for r in counts.collect()} == expected
    found = lambda prefix: sorted(((r.doc_id, r.lang) for r in language.detect_bayes(docs, counts, prefix).collect()), key=str)
    sent = found(None), found(2000), sorted(((r.doc_id, r.in_language) for r in language.is_in_language(docs, counts, "de").collect()), key=str)
    assert [x for x in sent[0] if x[0] in (1, None, 5)] == sorted([(1, "de"), (1, "en"), (None, "de"), (None, "en"), (5, "de")], key=str)
    assert [x for x in sent[0] if x[0] in (2, 3, 4)] == [(2, None), (3, None), (4, None)]
    assert sent[2] == sorted([(1, True), (1, False), (None, True), (None, False), (2, False), (3, False), (4, False), (5, True), (6, False), (7, False)], key=str)
    hits = sorted(((r.doc_id, r.lang) for r in language.detect(docs, language.profiles(known)).collect()), key=str)
    assert (6, None) in hits and len(hits) == len(rows)
    monkeypatch.setattr(language, "SENT_GRAMS", 3)
    short = docs.where("doc_id is null or doc_id <> 5")
    joined = sorted(((r.doc_id, r.lang) for r in language.detect_bayes(short, counts, None).collect()), key=str)
    assert joined == [x for x in sent[0] if x[0] != 5]
    assert language.detect_bayes(docs.limit(0), counts).count() == 0
    assert {r.lang for r in language.detect_bayes(docs, counts.limit(0)).collect()} == {None}
