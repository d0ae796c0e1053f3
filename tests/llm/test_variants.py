"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from wardline.llm import variants


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, min_length=5, min_count=3):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: sorted((-n[x], x) for x in n if edit_one(w, x)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS key", "3 AS cell", "4 AS near")


def fixture(seed=5):
    r = random.Random(seed)
    base = ["".join(r.choice("aeitnosrhlducmzàéÿ÷") for _ in range(r.randint(5, 9))) for _ in range(12)]

    def spelt():
        w = r.choice(base)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3])):
            k, c = r.randrange(len(w) + 1), r.choice("aetzÀé")
            w = r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]])
        return w.title() if r.random() < 0.2 else w
    rows = [(i, r.choice([" ", "-", "9", "\n", "Ā"]).join(spelt() for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "1 2 3"), (None, rows[4][1]), (5, rows[5][1]), (5, "abcde abcde"), (903, ("a" * 3000 + " ") * 4 + ("a" * 2999 + "b ") * 9),
             (904, "Straße STRASSE " * 9), (905, "strasse " * 30)]
    return rows


def test_variants_match_brute_force(spark):
    rows = fixture()
    got = variants.variants(frame(spark, rows).repartition(5))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in found) and any(r[4] > 3 for r in found)


def test_blocks_cut_into_many_pieces_give_the_same(spark, monkeypatch):
    rows = fixture(6)
    monkeypatch.setattr(variants, "PIECE", 2)
    monkeypatch.setattr(variants, "NEXT", 3)
    monkeypatch.setattr(variants, "FLUSH", 20)
    assert sorted(map(tuple, variants.variants(frame(spark, rows).repartition(3)).collect()), key=str) == brute(rows)


def test_long_chains_of_forms_end_at_their_root(spark):
    chain = ["abcde", "abcdf", "abcxf", "abyxf", "azyxf", "wzyxf"]
    rows = [(k, f"{w} " * (3 * 2 ** k)) for k, w in enumerate(chain)]
    got = {r["word"]: r["root"] for r in variants.variants(frame(spark, rows)).collect()}
    assert got == {w: r for w, _, r, *_ in brute(rows)} and got["abcde"] == "wzyxf"


def test_empty_table_and_no_words(spark):
    assert variants.variants(frame(spark, [])).collect() == []
    assert variants.variants(frame(spark, [(1, None), (2, "a bc abcde abcde")])).collect() == []
    with pytest.raises(ValueError):
        variants.variants(frame(spark, []), factor=1)


def test_every_edit_stays_in_adjacent_blocks(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        w = "".join(r.choice("aitoslzéq") for _ in range(r.randint(2, 8)))
        k, c = r.randrange(len(w)), r.choice("aitoslzéq")
        pairs += [(w, w[:k] + c + w[k:]), (w, w[:k] + c + w[k + 1:])]
    df = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a string, b string")
    ka, kb = variants.block(df["a"]), variants.block(df["b"])
    from pyspark.sql import functions as F
    keyed = df.select(ka.alias("ka"), kb.alias("kb"))
    seen = keyed.select((F.array_contains(variants.adjacent(F.col("ka")), F.col("kb")).cast("int")
                         + F.array_contains(variants.adjacent(F.col("kb")), F.col("ka")).cast("int")).alias("x"),
                        (F.col("ka") == F.col("kb")).alias("same"))
    assert all(r["x"] == (2 if r["same"] else 1) for r in seen.collect())
