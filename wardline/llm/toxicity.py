"""Toxicity score from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents removed, look-alike letters of
other alphabets and digits inside words mapped to Latin letters.  A lexicon
entry is a folded word with the log-odds weight learnt from labelled texts; an
exception phrase (two words, one of them in the lexicon) cancels the hit inside
it.  The sum of weights, normalised by the logarithm of the length, goes
through a logistic curve fitted on the same labelled texts.

Bound: at most ``max_labelled`` labelled rows are used to fit (the ones with
the smallest hash of the id, a documented sample), one text for each id; the
lexicon has every word of them that qualifies.  Every document is scored over
its whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, materialize, per_text

#: Letters that look like Latin ones, and digits or signs used for letters.
CYRILLIC_GREEK = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _table() -> dict[int, str]:
    """Lower case, no accent, full-width and mathematical letters, look-alikes."""
    out = {}
    for cp in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x370, 0x530),
               *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D6A4)]:
        c = unicodedata.normalize("NFKD", chr(cp)).lower()
        c = "".join(x for x in c if not unicodedata.combining(x))
        c = "".join(CYRILLIC_GREEK.get(x, x) for x in c)
        if c != chr(cp):
            out[cp] = c
    out |= {ord(k): v for k, v in CYRILLIC_GREEK.items()}
    out |= dict.fromkeys([0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), 0xFEFF])
    out |= {cp: " " for cp in [*range(0xBF), *range(0x2010, 0x2070), *range(0x3000, 0x3004)]
            if not chr(cp).isalnum() and chr(cp) not in DIGITS and cp != 0xAD}
    return out


FOLD = _table()
SUBSTITUTED = re.compile(r"(?<=[^\W\d_])[0-9@$]+|[0-9@$]+(?=[^\W\d_])")
SIGN = re.compile("[0-9@$]")
LEFT_OVER = str.maketrans("@$", "  ")
TO_LETTERS = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """Folded words joined, and surrounded, by one space."""
    t = text.lower().translate(FOLD)
    if SIGN.search(t):
        t = SUBSTITUTED.sub(lambda m: m[0].translate(TO_LETTERS), t).translate(LEFT_OVER)
    return f" {' '.join(t.split())} "


class Matcher:
    """Aho-Corasick automaton over `` word `` patterns and two-word exceptions."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.a = ahocorasick.Automaton()
        for w, x in weights.items():
            self.a.add_word(f" {w} ", (len(w) + 2, x))
        for p in exceptions:
            self.a.add_word(f" {p} ", (len(p) + 2, None))
        if len(self.a):
            self.a.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of lexicon hits outside exception phrases."""
        if not len(self.a):
            return []
        found, excused = [], []
        for end, (n, x) in self.a.iter(folded):
            (excused if x is None else found).append((end - n + 2, end, x))
        return [h for h in found if not any(s <= h[0] and h[1] <= e for s, e, _ in excused)]

    def feature(self, folded: str) -> tuple[float, int, int]:
        """Length-normalised weight, hits, words."""
        n, h = max(folded.count(" ") - 1, 0), self.hits(folded)
        return sum(x for _, _, x in h) / math.log2(8 + n), len(h), n


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = 20_000,
        min_docs: int = 3, min_weight: float = 2.0) -> dict:
    """Learn lexicon, exceptions and curve from ``labels(doc_id, <label>)``.

    Null labels or ids are ignored; without a labelled row of both classes the
    model gives every text the prior (0 without any label)."""
    spark = docs.sparkSession
    picked = (labels.select("doc_id", F.col(f"`{label_col}`").cast("int").alias("y")).dropna()
              .groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    train = (documents(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id")
             .agg(F.min("text").alias("text"), F.max("y").alias("y")))  # one row for each id, however often it is repeated
    train = materialize(train.select("text", "y"), "toxicity-train")

    n = {int(r["y"]): r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return {"weights": {}, "exceptions": [], "curve": (-20.0 if not pos else 20.0, 0.0)}

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count: dict[str, list[int]] = {}
            for t, y in zip(b["text"], b["y"]):
                for w in set(fold(t).split()):
                    count.setdefault(w, [0, 0])[y] += 1
            yield pd.DataFrame([(w, *c) for w, c in count.items()], columns=["w", "n0", "n1"])

    weight = F.log((F.col("n1") + 0.5) / pos) - F.log((F.col("n0") + 0.5) / neg)
    terms = (train.mapInPandas(words, "w string, n0 long, n1 long")
             .groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
             .where(F.col("n1") >= min_docs).withColumn("x", weight).where(F.col("x") >= min_weight)
             .orderBy(F.desc("x"), "w").collect())  # words of the labelled rows
    weights = {r["w"]: round(r["x"], 6) for r in terms}

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count: dict[str, list[int]] = {}
            for t, y in zip(b["text"], b["y"]):
                ws = fold(t).split()
                for p in {f"{u} {v}" for u, v in zip(ws, ws[1:]) if u in weights or v in weights}:
                    count.setdefault(p, [0, 0])[y] += 1
            yield pd.DataFrame([(w, *c) for w, c in count.items()], columns=["w", "n0", "n1"])

    exceptions = [r["w"] for r in
                  train.mapInPandas(phrases, "w string, n0 long, n1 long")
                  .groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
                  .where((F.col("n0") >= min_docs) & (F.col("n1") == 0))
                  .orderBy(F.desc("n0"), "w").collect()]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(weights, exceptions)
        for b in batches:
            yield pd.DataFrame({"x": [m.feature(fold(t))[0] for t in b["text"]], "y": b["y"]})

    xy = train.mapInPandas(features, "x double, y int").toPandas()  # at most max_labelled rows
    return {"weights": weights, "exceptions": exceptions, "curve": _curve(xy["x"].to_numpy(), xy["y"].to_numpy())}


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic intercept and slope by Newton's method, lightly penalised."""
    A, w = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(A @ w, -30, 30)))
        step = np.linalg.solve(A.T @ (A * (p * (1 - p))[:, None]) + ridge * np.eye(2), A.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, n_hits, n_words) for every row of ``docs``.

    Null or empty texts have no hit and get the curve's value at 0; repeated
    rows are scored each."""
    a, b = model["curve"]

    def make():
        m = Matcher(model["weights"], model["exceptions"])

        def one(text: str) -> tuple:
            x, hits, n = m.feature(fold(text))
            s = round(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x)))), 9)
            return s, int(s >= threshold), hits, n
        return one

    return per_text(documents(docs), None, "score double, predicted int, n_hits int, n_words long", make)


def held_out(col="doc_id"):
    """crc32 of the id as text, modulo 3, is 1 (null id: never held out)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **fit_params) -> DataFrame:
    """Fit on the labelled rows that are not held out, then score all."""
    model = fit(docs, labels.where(~held_out()), **fit_params)
    return score(docs, model).withColumn("held_out", held_out())
