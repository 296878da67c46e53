import re

import pytest

from spanloom.llm import decontaminate as d

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(len(v), 10)
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    ids.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return sorted(out, key=repr)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my"
DOCS = [
    (1, None), (2, ""), (3, "…"), (4, LONG.upper() + " end"), (4, LONG.upper() + " end"), (5, "x " + LONG.replace(" ", ", ") + " " + LONG),
    (6, "the cat sat"), (7, "the the the the"), (None, "a b c d e the cat"), (8, "Élan É über 9 The Cat"), (9, "w " * 30000 + LONG), (10, "a a a a a a a a a a a a"),
]
ITEMS = [(1, LONG), (2, "the CAT"), (2, "the the"), (None, "sat"), (3, None), (4, "!!"), (5, "élan É"), (6, "a " * 11), (7, "never seen words")]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_against_brute_force(spark, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as h", "2 as words", "3 as n_words")
    out = d.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast_words=limit).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out], key=repr) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, items).count() == 0
    out = d.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).collect()
    assert [(r.n_words, r.n_hit) for r in out] == [(2, 0)]


def test_nulls_beside_strings(spark):
    docs = [("the cat", None), (None, "the cat"), ("x", "the cat"), (None, None)]
    out = d.decontaminate(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(1, "the cat")], "item_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out], key=repr) == brute(docs, [(1, "the cat")])
