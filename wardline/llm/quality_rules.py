"""Quality rules as a short-circuit cascade.

Each rule is a predicate over one text's words and counts.  On a hash sample of
documents every rule is timed, in the tasks, and applied.  The order is chosen
greedily: of the rules left, the one with the most rejections per cost among
the sampled texts that the rules before it let through.  A document then stops
at the first rule that rejects it, and a count that two rules share is made
once.  The order changes the work, never the verdict: a document is kept when
no rule rejects it.

Words are maximal runs of anything but ASCII white space; null text has none.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, per_text

#: Signs that count as symbols.
SYMBOLS = "[#*$%&|<>]"
_SYMBOL_BYTES = b"#*$%&|<>"


class Text:
    """A text and what rules share; each count is made when first asked for and
    remembered."""

    def __init__(self, text: str):
        self.text, self._b = text, text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self._b.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def _word_chars(self) -> int:
        return len(self.text) - (len(self._b) - len(self._b.translate(None, b" \t\n\v\f\r")))

    @cached_property
    def _symbols(self) -> int:
        return len(self._b) - len(self._b.translate(None, _SYMBOL_BYTES))

    @cached_property
    def _lines(self) -> list[bytes]:
        return [x for x in self._b.split(b"\n") if x.strip(b" \t\n\v\f\r")]

    @cached_property
    def _repeat_words(self) -> int:
        w, n = self.words, self.n_words
        if n < 4:
            return 0
        seen = Counter(zip(w, w[1:], w[2:]))
        if len(seen) == n - 2:
            return 0
        hit = np.fromiter((seen[k] > 1 for k in zip(w, w[1:], w[2:])), bool, n - 2)
        cover = np.zeros(n, bool)
        cover[:-2] |= hit
        cover[1:-1] |= hit
        cover[2:] |= hit
        return int(cover.sum())

    def word_chars(self) -> int:
        return self._word_chars

    def n_symbols(self) -> int:
        return self._symbols

    def n_dup_lines(self) -> int:
        return len(self._lines) - len(set(self._lines))

    def n_lines(self) -> int:
        return len(self._lines)

    def n_repeat_words(self) -> int:
        """Words inside a three-word window found twice or more."""
        return self._repeat_words

    def n_upper(self) -> int:
        return sum(1 for x in self.words if x.isupper() and len(x) > 1)


#: (name, rejects): the two of the base, then those of the cascade.
BASE: list[tuple[str, Callable[[Text], bool]]] = [
    ("few_words", lambda t: t.n_words < 50),
    ("repeated_windows", lambda t: 100 * t.n_repeat_words() > 50 * t.n_words),
]
RULES: list[tuple[str, Callable[[Text], bool]]] = [
    ("symbols", lambda t: 10 * t.n_symbols() > 3 * t.n_words),
    ("duplicate_lines", lambda t: 10 * t.n_dup_lines() > 5 * t.n_lines()),
    ("word_length", lambda t: not 2 * t.n_words <= t.word_chars() <= 15 * t.n_words),
    ("shouting", lambda t: 10 * t.n_upper() > 5 * t.n_words),
]


ALL = [*BASE, *RULES]


def trial(docs: DataFrame, rules=None, sample_rows: int = 400) -> list[tuple[int, str, bool, float]]:
    """(text, rule, rejects, seconds) of every rule on at most ``sample_rows``
    documents, those with the smallest hash of the id; each rule is timed on its
    own, where the text is.  Only the order comes from this sample."""
    rules = rules or ALL
    d = documents(docs)
    ids = d.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = d.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"]):
                for name, rejects in rules:
                    x, began = Text(text), time.perf_counter()
                    hit = bool(x.n_words and rejects(x))
                    rows.append((i, name, hit, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["text", "rule", "hit", "seconds"])

    got = texts.mapInPandas(run, "text long, rule string, hit boolean, seconds double").collect()  # sample_rows x rules numbers
    return [tuple(r) for r in got]


def greedy(tried: list[tuple[int, str, bool, float]]) -> list[tuple[str, float, float]]:
    """(rule, share rejected of the texts that reach it, seconds a text), in the
    order of rejections per second given the rules before."""
    rules = sorted({r for _, r, _, _ in tried})
    hits = {r: {t for t, x, h, _ in tried if x == r and h} for r in rules}
    cost = {r: sum(s for _, x, _, s in tried if x == r) / max(1, sum(x == r for _, x, _, _ in tried)) for r in rules}
    left, out = {t for t, *_ in tried}, []
    while rules:
        def worth(r):
            return (len(hits[r] & left) + 0.5) / (len(left) + 1) / (cost[r] + 1e-9)
        best = max(rules, key=lambda r: (worth(r), r))
        out.append((best, len(hits[best] & left) / len(left) if left else 0.0, cost[best]))
        left -= hits[best]
        rules.remove(best)
    return out


def plan(docs: DataFrame, rules=None, sample_rows: int = 400) -> list[str]:
    """Rule names in the order of :func:`greedy`; without a sample, as given."""
    order = [r for r, _, _ in greedy(trial(docs, rules, sample_rows))]
    return order or [name for name, _ in rules or ALL]


def verdict(t: Text, order: list[str], by_name: dict) -> tuple[str | None, int]:
    """(the rule that rejects, rules checked): later rules are never asked."""
    if not t.n_words:
        return "no_words", 0
    for k, name in enumerate(order):
        if by_name[name](t):
            return name, k + 1
    return None, len(order)


def cascade(docs: DataFrame, order: list[str], rules=None) -> DataFrame:
    """(doc_id, kept, rejected_by, n_checked): rules in ``order``, stopping at
    the first that rejects.  A text without words is rejected by ``no_words``."""
    by_name = dict(rules or ALL)

    def one(text: str) -> tuple:
        by, n = verdict(Text(text), order, by_name)
        return by is None, by, n

    return per_text(documents(docs), one, "kept boolean, rejected_by string, n_checked int")


def measure(docs: DataFrame, order: list[str], rules=None) -> DataFrame:
    """The cascade's verdict on every document, and all base counts; those that
    a rule has made are taken from it."""
    by_name = dict(rules or ALL)

    def one(text: str) -> tuple:
        t = Text(text)
        by, n = verdict(t, order, by_name)
        failed = any(rejects(t) for _, rejects in BASE)
        return t.n_words, t.word_chars(), t.n_symbols(), t.n_dup_lines(), t.n_repeat_words(), failed, by is None and not failed, by, n

    return per_text(documents(docs), one,
                    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                    "base_failed boolean, kept boolean, rejected_by string, n_checked int")


def quality_rules(docs: DataFrame, sample_rows: int = 400) -> DataFrame:
    """Order the cascade of all rules on a sample, then run it over all documents."""
    return measure(docs, plan(docs, ALL, sample_rows))
