"""Guess costs: the corpus dictionary, and the programme against all segmentations."""

import functools
import math
import random

from wardline.llm import secrets


def span_bits(value, words):
    """Least bits of a span taken as one part; inf if it is none."""
    n, low = len(value), value.lower()
    plain = low.translate(secrets.LEET)
    out = [math.inf]
    classes = {secrets._class(c) for c in value}
    size = sum(secrets.SIZES[k] for k in classes)
    out.append(n * math.log2(size) + secrets.CHOICE)
    if secrets._class(value[0]) == secrets.CAPITAL and all(secrets._class(c) == secrets.SMALL for c in value[1:]):
        out.append(n * math.log2(26) + secrets.CHOICE)
    if n >= secrets.SHORTEST and plain in words:
        case = 0 if value == low else 1 if value.isupper() or value.istitle() else n / 2
        out.append(words[plain] + case + (plain != low))
    if secrets.DATE.match(low) and any(m and m.end() == n for m in [secrets.DATE.match(low)]):
        out.append(math.log2(365 * 120 if n > 4 else 120))
    if n >= 3 and len(set(value)) == 1:
        out.append(math.log2(secrets.SIZES[secrets._class(value[0])]) + math.log2(n))
    if n >= 3 and all(p in secrets.NEXT for p in zip(low, low[1:])):
        out.append(math.log2(2 * sum(map(len, secrets.ROWS))) + math.log2(n))
    return min(out)


def exhaustive(value, words):
    @functools.cache
    def best(j):
        return 0.0 if not j else min(best(i) + span_bits(value[i:j], words) + (i > 0) for i in range(j))
    return best(len(value))


def test_cost_is_the_least_over_all_segmentations():
    words = {"abc": 3.0, "tiger": 6.5, "ger": 2.0, "tig": 4.0, "love": 1.0}
    r = random.Random(6)
    parts = ["abc", "Tiger", "tiger", "LOVE", "l0ve", "2019", "1985-07-14", "aaaa", "zzz", "qwer", "poiu", "x", "9", "#", "é", "tiGer"]
    for _ in range(400):
        v = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        got = secrets.least_bits(v, words, 5)
        assert got <= exhaustive(v, words) + 1e-9
        if not any(c.isdigit() for c in v):  # dates may end early in the programme, never later
            assert got >= exhaustive(v, words) - 1e-9


def test_dictionary_is_ranked_by_the_corpus(spark):
    rows = [(i, "the horse ate the CORRECT staple " * 3 + f"once{chr(97 + i % 26) * 4}") for i in range(30)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS w", "1 AS n").repartition(3)
    words = secrets.dictionary(df)
    assert words["the"] == 1.0 and words["horse"] < 4 and "correct" in words and "onceaaaa" not in words
    assert words["password"] <= 1.0 + 1e-9 and secrets.dictionary(df.limit(0)) == secrets.RANK
    assert len(secrets.dictionary(df, max_words=2)) <= len(secrets.RANK) + 2


def test_phrases_of_common_words_are_guessable_and_random_ones_are_not(spark):
    words = ["correct", "horse", "battery", "staple", "chocolate", "elephant"]
    rows = [(i, " ".join(words) + " and more") for i in range(40)]
    rows += [(100, "password: correcthorsebattery"), (101, "secret is ChocolateElephant1"), (102, "password: vkqzhwpxjrtbnydm"), (103, "pwd = Xk9#mQ2p")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["bits"]) for s in r["spans"]] for r in secrets.secret_spans(df).collect()}
    assert "guess" not in {k for k, _ in got[101]} and "guess" in {k for k, _ in got[103]}
    assert [k for k, _ in got[100]] == ["assign"]  # a base span stays, whatever its cost
    learnt = secrets.dictionary(df)
    assert secrets.Guesser(learnt).bits("correcthorsebattery") < secrets.MIN_BITS < secrets.Guesser(learnt).bits("vkqzhwpxjrtbnydm")
    assert secrets.guess_bits("correcthorsebattery") > secrets.MIN_BITS


def test_any_number_of_blanks_around_the_sign():
    text = "pwd" + " " * 500 + "=" + " " * 500 + "Xk9#mQ2p"
    assert [k for k, _, _ in secrets.scan(text)[1]] == ["guess"]
