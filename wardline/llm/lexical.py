"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items form one automaton whose outputs map to items.  Every
term is guarded by a boundary on both sides, and a text is folded so that each
separator is that boundary, so a match is a whole term.  Documents have no
index: two scans read their texts.

1. The first counts the documents with a term (N), all terms (L) and, through
   the automaton, the documents that hold each item term (df).
2. The second counts the occurrences of item terms in a document (tf), scores
   it for all items that hold one of them, and keeps each item's best in the
   task.  A last ranking per item reads that many rows from each task.

Only what belongs to the items is collected and sent to the tasks: terms,
weights and the item lists of the terms.  Its bound is checked: the items are
dealt into blocks by the size of their terms, ``MAX_POSTINGS`` (item, term)
pairs on average, and each block is one search over all documents.  What a task
holds is one batch of scores, of at most ``CELLS`` numbers, and the best rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import documents, materialize

MAX_POSTINGS = 200_000
CELLS = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_second = itemgetter(1)


def folded(text: str) -> bytes:
    """The UTF-8 bytes of ``text``: A-Z lower-cased, every byte that can't be
    part of a term a space, so that ``split`` gives the terms."""
    return text.encode().translate(_FOLD)


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term) of all items; a term is its UTF-8 bytes, folded."""
    d = items.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = d.schema["item"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, t) for i, text in zip(b["item"], b["text"]) for t in {*folded(text).split()}]
            yield pd.DataFrame(rows, columns=["item", "term"])

    return (d.withColumn("item", F.col("item").cast("string")).mapInPandas(run, "item string, term binary")
            .distinct().withColumn("item", F.col("item").cast(kind)))


class Terms:
    """The automaton of one block of items, built in each task."""

    def __init__(self, terms: list[bytes]):
        self.n = len(terms)
        self.a = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            self.a.add_word(f" {t.decode('latin-1')} ", k)
        self.a.make_automaton()

    def counts(self, text: bytes) -> Counter:
        """Occurrences of each term in a folded text, by its number."""
        return Counter(map(_second, self.a.iter(f" {text.decode('latin-1')} ")))


def statistics(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term) over all documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Terms(terms)
        df, some, total = np.zeros(m.n, np.int64), 0, 0
        for b in batches:
            for text in b["text"]:
                t = folded(text)
                n = len(t.split())
                some, total = some + (n > 0), total + n
                if n:
                    df[[*m.counts(t)]] += 1
        k = np.flatnonzero(df)
        yield pd.DataFrame({"k": np.concatenate([k, [-1, -2]]), "c": np.concatenate([df[k], [some, total]])})

    got = docs.select("text").mapInPandas(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    by = {r["k"]: r["c"] for r in got}  # at most one row for each term and two more
    return by.get(-1, 0), by.get(-2, 0), np.array([by.get(k, 0) for k in range(len(terms))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def best(item: np.ndarray, score: np.ndarray, empty: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Places of each item's ``top`` highest scores, ties by id, no id last."""
    by = np.lexsort((doc, empty, -score, item))
    sorted_item = item[by]
    first = np.searchsorted(sorted_item, sorted_item, side="left")
    return by[np.arange(len(by)) - first < top]


def scan(docs: DataFrame, terms: list[bytes], lists: list[np.ndarray], n_items: int, stats: tuple, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in each task."""
    n_docs, total, df = stats
    w = weights(n_docs, df)
    size = np.array([len(x) for x in lists], np.int64)
    start = np.cumsum(size) - size
    items = np.concatenate(lists).astype(np.int64)
    step = max(1, CELLS // n_items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Terms(terms)
        kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is missing, id
        least = np.ones(n_items, np.int64)  # a lower score can't be among the best any more
        for b in batches:
            texts, ids, none = b["text"].to_numpy(), b["doc"].to_numpy(np.int64), b["none"].to_numpy(np.int64)
            for lo in range(0, len(texts), step):
                ks, tfs, owners, norms = [], [], [], []
                for i, text in enumerate(texts[lo:lo + step]):
                    t = folded(text)
                    c = m.counts(t)
                    if c:
                        n = len(t.split())
                        ks.extend(c)
                        tfs.extend(c.values())
                        owners.extend([i] * len(c))
                        norms.extend([10 + 90 * n * n_docs // total] * len(c))
                if not ks:
                    continue
                k, tf = np.array(ks), np.array(tfs, np.int64)
                part = w[k] * (1_000_000_000 * tf // (1000 * tf + 8 * np.array(norms, np.int64)))
                deg = size[k]
                at = np.repeat(start[k] - (np.cumsum(deg) - deg), deg) + np.arange(deg.sum())
                scores = np.zeros(min(step, len(texts) - lo) * n_items, np.int64)
                np.add.at(scores, np.repeat(np.array(owners) * n_items, deg) + items[at], np.repeat(part, deg))
                scores = scores.reshape(-1, n_items)
                row, item = np.nonzero(scores >= least)
                if not len(row):
                    continue
                new = (item, scores[row, item], none[lo + row], ids[lo + row])
                kept = [np.concatenate(x) for x in zip(kept, new)]
                keep = best(*kept, top)
                kept = [x[keep] for x in kept]
                full = np.bincount(kept[0], minlength=n_items) >= top
                floor = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(floor, kept[0], kept[1])
                least[full] = floor[full]
        yield pd.DataFrame({"pos": kept[0], "score": kept[1], "none": kept[2].astype(bool), "doc": kept[3]})

    d = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("doc_id").isNull().alias("none"), "text")
    out = d.mapInPandas(run, "pos long, score long, none boolean, doc long")
    return out.select("pos", F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, item_col: str = "item_id",
           max_postings: int = MAX_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents.

    Null and empty texts have no term: such a document matches nothing and such
    an item has no row.  Rows that repeat an item's id are one item with the
    terms of all of them (no id is one id too); rows that repeat a doc_id are
    ranked each; among equal scores the smaller id comes first and a missing
    one last.  Empty tables give no rows; other columns are never read."""
    d = documents(docs)
    pairs = materialize(item_terms(items, item_col), "item-terms")
    spark, kind = docs.sparkSession, pairs.schema["item"].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    blocks = -(-pairs.count() // max_postings)
    out = None
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else pairs
        rows = mine.collect()  # of one block: bounded, see above
        if not rows:
            continue
        ids = sorted({r["item"] for r in rows}, key=lambda x: (x is None, x if x is not None else 0))
        place = {x: i for i, x in enumerate(ids)}
        by_term: dict[bytes, list[int]] = {}
        for r in rows:
            by_term.setdefault(bytes(r["term"]), []).append(place[r["item"]])
        terms = sorted(by_term)
        stats = statistics(d, terms)
        if not stats[1]:
            continue
        found = scan(d, terms, [np.array(by_term[t]) for t in terms], len(ids), stats, top)
        names = spark.createDataFrame(list(enumerate(ids)), f"pos long, item_id {kind}")
        w = Window.partitionBy("pos").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        part = ranked.join(F.broadcast(names), "pos").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return empty if out is None else out
