"""Spelling variants: near words found by blocked Gram matrices of letter counts.

1. Runs of letters are counted in the tasks, then by word.
2. Words fall into blocks: their letter counts summed over ``GROUPS`` of letters
   (so all words of a block have one length).  One edit changes the sums of one
   group by one, or moves one from a group to another; so a near word lies in
   the same block or in one of a few adjacent ones, which any word can name.
3. A block meets its adjacent blocks once.  In a task, the product of their
   letter-count matrices (a Gram block) gives all squared distances at once;
   pairs at most two apart are kept and their edit is verified letter by letter.
   Blocks of many words are cut into pieces, and each piece of a block meets
   each piece of what is adjacent to it, so a task holds at most
   ``PIECE`` + ``NEXT`` words, and fewer of long ones.
4. Each word follows its form; as the count at least doubles from a word to its
   form, chains are short, and pointer doubling finds their ends in few rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, materialize

RUN = re.compile("[a-zÀ-ÿ]+")
#: Groups of letters that hold about the same share of text in languages of
#: Latin script; letters named in none belong to the last.
GROUPS = ("ae", "itn", "osrh", "lducm", None)
PIECE, NEXT, CELLS = 1024, 8192, 1 << 20
FLUSH = 400_000
#: Dimensions of the letter counts: 26 letters and six for the accented ones.
#: Letters that share a dimension only bring texts closer, so no pair is lost.
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])


def changed(run: str, start: int) -> str:
    """The run as the operator counts it: if the crc32 of id and run is a
    multiple of 97, one letter is gone.  ``start`` is the crc32 of ``<id>:``."""
    h = zlib.crc32(run.encode(), start)
    if h % 97:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of words of ``min_length`` letters found ``min_count`` times."""
    def table(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for i, text in zip(b["doc_id"], b["text"]):
                start = zlib.crc32(f"{i}:".encode())
                # bytes.lower changes A-Z only
                for w, k in Counter(RUN.findall(text.encode().lower().decode())).items():
                    w = changed(w, start)
                    if len(w) >= min_length:
                        total[w] += k
                if len(total) > FLUSH:
                    yield table(total)
                    total.clear()
        yield table(total)

    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return (d.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def block(word: Column) -> Column:
    """Letters of each group, as an array; its sum is the word's length."""
    named = [F.length(word) - F.length(F.translate(word, g, "")) for g in GROUPS if g]
    rest = F.length(F.translate(word, "".join(g for g in GROUPS if g), ""))
    return F.array(*[x.cast("int") for x in (*named, rest)])


def adjacent(key: Column) -> Column:
    """Blocks that a block has to meet: itself, those with a letter more in one
    group, and, of two blocks with a letter moved between groups, the greater.
    Each pair of adjacent blocks is named from one side only."""
    g = range(len(GROUPS))

    def moved(up: int | None, down: int | None) -> Column:
        return F.array(*[key[i] + ((i == up) - (i == down)) for i in g])
    # the greater in the order of the groups: the letter moves to an earlier group
    return F.array(key, *[moved(i, None) for i in g], *[moved(i, j) for i in g for j in g if i < j])


def counts_of(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters, letter counts) of words of one length."""
    codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
    at = np.arange(len(words))[:, None] * 32 + _DIM[codes]
    kind = np.float32 if size < 2048 else np.float64  # sums of squares stay exact
    return codes, np.bincount(at.ravel(), minlength=32 * len(words)).reshape(-1, 32).astype(kind)


def near_pairs(a: list[bytes], b: list[bytes], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of words one edit apart.  Words of ``a`` have
    one length, words of ``b`` the same or one more; ``same``: each pair of one
    list once."""
    none = np.zeros(0, np.int64)
    if not a or not b:
        return none, none
    n, m = len(a[0]), len(b[0])
    ca, xa = counts_of(a, n)
    cb, xb = counts_of(b, m)
    apart = (xa * xa).sum(1)[:, None] + (xb * xb).sum(1)[None, :] - 2 * (xa @ xb.T)
    i, j = np.nonzero(apart <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    step = max(1, (4 << 20) // max(m, 1))
    for lo in range(0, len(i), step):
        p, q = ca[i[lo:lo + step]], cb[j[lo:lo + step]]
        if n == m:
            keep[lo:lo + step] = (p != q).sum(1) == 1
        else:  # equal up to some letter, and equal after the letter that is more
            left = np.cumprod(p == q[:, :n], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
            right = np.cumprod((p == q[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
            keep[lo:lo + step] = left + right >= n
    return i[keep], j[keep]


def _meet(g: pd.DataFrame) -> pd.DataFrame:
    """Near pairs, in both directions, between the words of a piece of a block
    (side 0) and a piece of what it meets (side 1; its own words are side 1 too)."""
    mine, other = g[g["side"] == 0], g[g["side"] == 1]
    out = []
    if len(mine):
        a = [w.encode("latin-1") for w in mine["word"]]
        b = np.array([w.encode("latin-1") for w in other["word"]], dtype=object)
        size = np.array([len(w) for w in b])
        na, nb = mine["n"].to_numpy(), other["n"].to_numpy()
        own = other["own"].to_numpy(bool)
        wa, wb = mine["word"].to_numpy(object), other["word"].to_numpy(object)
        for at in (np.flatnonzero(own), np.flatnonzero(~own & (size == len(a[0]))), np.flatnonzero(size == len(a[0]) + 1)):
            i, j = near_pairs(a, list(b[at]), False)
            j = at[j]
            if len(at) and own[at[0]]:  # both words meet here, in either order: once is enough
                once = wa[i] < wb[j]
                i, j = i[once], j[once]
            out += [(wa[i], wb[j], nb[j]), (wb[j], wa[i], na[i])]
    word, near, near_n = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
    return pd.DataFrame({"word": pd.Series(word, dtype=object), "near": pd.Series(near, dtype=object), "near_n": pd.Series(near_n, dtype="int64")})


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all words one edit apart, in both directions."""
    keyed = words.withColumn("key", block(F.col("word")))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("b")), "blocks")
    meets = sizes.select("key", F.explode(adjacent(F.col("key"))).alias("to"))
    length = F.aggregate("key", F.lit(0), lambda s, x: s + x)
    total = (meets.join(sizes.select(F.col("key").alias("to"), "b"), "to").groupBy("key").agg(F.sum("b").alias("next")))
    # pieces of at most PIECE and NEXT words on average, and of CELLS letters
    grid = materialize(total.join(sizes, "key").select(
        "key", F.ceil(F.col("b") / F.greatest(F.lit(1), F.least(F.lit(PIECE), F.lit(CELLS) / length))).alias("pa"),
        F.ceil(F.col("next") / F.greatest(F.lit(1), F.least(F.lit(NEXT), F.lit(8 * CELLS) / length))).alias("pn")), "grid")
    # who meets a block: the pairs above, read from the other end
    seen_by = materialize(meets.join(sizes.select(F.col("key").alias("to")), "to").join(grid, "key")
                          .select("to", F.col("key").alias("at"), "pa", "pn"), "meets")
    h = F.xxhash64("word")
    mine = keyed.join(grid, "key").select(
        F.col("key").alias("at"), F.pmod(h, F.col("pa")).alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("pn") - 1)).alias("j"), F.lit(0).alias("side"), F.lit(True).alias("own"), "word", "n")
    other = keyed.join(seen_by, F.col("key") == F.col("to")).select(
        "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pa") - 1)).alias("i"),
        F.pmod(F.shiftright(h, 8), F.col("pn")).alias("j"), F.lit(1).alias("side"), (F.col("at") == F.col("key")).alias("own"), "word", "n")
    cells = mine.unionByName(other).withColumn("cell", F.concat_ws(",", "at", F.col("i"), F.col("j")))
    return cells.groupBy("cell").applyInPandas(lambda g: _meet(g), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the end of each chain of forms."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")), "roots")
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(df: DataFrame, min_length: int = 5, min_count: int = 3, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    A word is near another if one letter is more, less or another.  Its form is
    the near word of largest n (ties: the smallest), if that is ``factor`` times
    its own n or more, else null; its root is the end of the chain of forms, or
    the word itself.  Null and empty texts have no words; a null id counts as an
    empty one in the change of runs; repeated rows count each; an empty table
    gives no rows; other columns are never read."""
    if factor < 2:
        raise ValueError("factor must be at least 2: chains of forms have to end")
    words = materialize(word_counts(documents(df), min_length, min_count), "words")
    near = (links(words).groupBy("word").agg(F.count("*").alias("n_near"),
                                             F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("top")))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.less") >= factor * F.col("n"), F.col("top.near")).alias("form"),
        F.when(-F.col("top.less") >= factor * F.col("n"), -F.col("top.less")).alias("form_n"))
    judged = materialize(judged, "judged")
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
