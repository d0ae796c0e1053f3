"""Ranked lexical search against a direct reading of its formula."""

import math
import random
import re

import pytest

from wardline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=10):
    found = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, total = len(found), sum(len(t) for _, t in found)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        rows = []
        for i, t in found:
            m = 10 + 90 * len(t) * n_docs // total
            s = 0
            for x in ts:
                df, tf = sum(x in u for _, u in found), t.count(x)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS item", "2 AS score", "3 AS pos", "4 AS doc")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS doc_id", "8 AS item", "9 AS term", "1 AS rank")
    return d, i


def fixture():
    r = random.Random(3)
    words = ["Alpha", "beta", "gamma9", "ÉTÉ", "été", "x", " ", "delta e", "42", "ALPHA"]
    docs = [(i, r.choice([" ", "-", ". ", "\t\n", "\x1c"]).join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " ... "), (503, "alpha " * 30_000), (7, docs[7][1]), (7, "beta beta"), (None, "gamma9 x x")]
    items = [(1, "Alpha beta"), (2, "alpha-alpha GAMMA9"), (3, None), (4, "unheard of"), (5, "x   été"), (2, "42"), (None, "beta")]
    return docs, items


def test_search_matches_the_formula(spark):
    docs, items = fixture()
    d, i = frames(spark, docs, items)
    got = lexical.search(d.repartition(5), i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)


def test_blocks_of_items_and_small_batches_give_the_same(spark, monkeypatch):
    docs, items = fixture()
    d, i = frames(spark, docs, items)
    monkeypatch.setattr(lexical, "CELLS", 12)
    got = lexical.search(d.repartition(3), i, top=4, max_postings=4)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 4)


def test_many_ties_keep_the_least_ids(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(i, "other") for i in range(400, 900)]
    d, i = frames(spark, docs, [(1, "words")])
    got = sorted((r["rank"], r["doc_id"]) for r in lexical.search(d.repartition(7), i).collect())
    assert got == [(k, k) for k in range(1, 11)]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_tables_and_texts(spark, docs, items):
    d, i = frames(spark, docs, items)
    assert lexical.search(d, i).collect() == []


def test_long_text_and_boundaries():
    m = lexical.Terms([b"a", b"ab", "é".encode()])
    assert m.counts(lexical.folded("a ab A,AB ba é éa " * 2)) == {0: 4, 1: 4, 2: 2}
    assert len(lexical.folded("word " * 200_000).split()) == 200_000
