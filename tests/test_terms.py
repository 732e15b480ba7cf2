"""Terms in texts: compound words, claims of overlapping finds, and missed targets, against patterns tried one by one."""

import random
import re
import time

import numpy as np
import pytest

from termweave.operators import glossary

ENDINGS = "(?:e|en|er|es|n|s)?"


def found(text, terms, compound):
    """Rows and counts of terms (row, source): each pattern in turn, the longest first, on what is still free."""
    free, counts = [True] * len(text), {}
    for row, term in sorted(terms, key=lambda t: (-len(t[1]), t[0])):
        for m in re.finditer(("" if compound else r"(?<!\w)") + re.escape(term) + ENDINGS + r"(?!\w)", text, re.IGNORECASE):
            if all(free[m.start() : m.end()]):
                free[m.start() : m.end()] = [False] * (m.end() - m.start())
                counts[row] = counts.get(row, 0) + 1
    return counts


TEXTS = [
    "Die Anlagenfreigabe erfolgt. Er will freigeben. Zwei Freigaben, FREIGABE und freigabe.",
    "Das Freigabeverfahren läuft, die Verfahren auch; Freigabe Verfahren",
    "Brennstabbündel und Brennstab und Restbrennstäbe",
    "spent fuel pool, Spent Fuel Pools; respent fuel pool carpool",
    "a b a b a b a b a b",
    None,
    "",
    "nn nnn n en een",
]
TERMS = [(2, "Freigabe"), (3, "Freigabeverfahren"), (4, "Verfahren"), (5, "Brennstab"), (6, "Brennstabbündel"), (7, "spent fuel pool"), (8, "pool"), (9, "a b"), (10, "b a"), (11, "n"), (12, ""), (13, "fuel pool"), (14, "en")]


@pytest.mark.parametrize("compound", [False, True])
def test_terms(spark, compound):
    rng = random.Random(7)
    made = [" ".join(rng.choice(["a", "b", "ba", "en", "xn", "fuel", "pool", "carpool", "Freigabe", "Anlagenfreigabe"]) for _ in range(40)) for _ in range(60)]
    texts = TEXTS + made
    units = spark.createDataFrame([(i // 3 if i < 60 else None, i, t, 1) for i, t in enumerate(texts)], "doc_id long, unit_idx int, text string, row int")
    terms = spark.createDataFrame([(r, t, "x") for r, t in TERMS], "row int, source string, word string")
    got = {(r.doc_id, r.unit_idx, r.row): r.n for r in glossary.match_terms(units, terms, compound).collect()}
    expected = {(i // 3 if i < 60 else None, i, row): n for i, t in enumerate(texts) for row, n in found(t or "", [t for t in TERMS if t[1]], compound).items()}
    assert got == expected
    assert glossary.match_terms(units, terms.limit(0), compound).count() == 0
    assert glossary.match_terms(units.limit(0), terms, compound).count() == 0


def greedy(finds):
    kept = []
    for f in sorted(finds, key=lambda f: (f[0], -f[3], f[4], f[1])):
        if not any(f[0] == k[0] and f[1] < k[2] and k[1] < f[2] for k in kept):
            kept.append(f)
    return set(kept)


def test_claims():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        unit, at, row = rng.integers(0, 4, n), rng.integers(0, 60, n), rng.integers(0, 6, n)
        size = row % 3 + 1
        finds = list({(int(u), int(a), int(a + s), int(s * 3), int(r)) for u, a, s, r in zip(unit, at, size, row)})
        columns = [np.array([f[i] for f in finds]) for i in range(5)]
        keep = glossary.winners(*columns)
        assert {f for f, k in zip(finds, keep) if k} == greedy(finds)
    assert not len(glossary.winners(*[np.zeros(0, np.int64)] * 5))


def test_claims_of_a_long_unit_take_time_in_proportion():
    """A unit where every find meets the next one."""
    took = []
    for n in (50_000, 200_000):
        at = np.arange(n)
        began = time.process_time()
        keep = glossary.winners(np.zeros(n, np.int64), at, at + 3, np.full(n, 3), at % 2)
        took.append(time.process_time() - began)
        assert keep.sum() >= n // 4
    assert took[1] < 12 * took[0] + 0.5


def test_missed_terms(spark):
    """A target counts as often as the term: in any case, inflected, of several words, and in compounds of some languages."""
    rows = [(1, 0, "Clearance, clearances and spent fuel pool."), (1, 1, "Approval and the pool."), (1, 2, None), (2, 0, "das Anlagenbecken"), (2, 1, "Q.E.D (a+b)")]
    answers = spark.createDataFrame(rows, "doc_id long, unit_idx int, text string")
    terms = spark.createDataFrame([(2, "clearance"), (3, "spent fuel pool"), (4, "Becken"), (5, "(a+b"), (6, r"\Ex")], "row int, target string")
    matches = spark.createDataFrame([(1, 0, 2, 2), (1, 0, 3, 1), (1, 0, 6, 1), (1, 1, 2, 1), (1, 1, 3, 1), (1, 2, 2, 1), (2, 0, 4, 1), (2, 1, 5, 1)], "doc_id long, unit_idx int, row int, n long")
    missed = lambda compound: {tuple(r) for r in glossary.missed_terms(matches, answers, terms, compound).collect()}
    assert missed(False) == {(1, 0, 6), (1, 1, 2), (1, 1, 3), (1, 2, 2), (2, 0, 4)}
    assert missed(True) == {(1, 0, 6), (1, 1, 2), (1, 1, 3), (1, 2, 2)}
