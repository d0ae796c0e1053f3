"""Removal of repeated byte strings by a sampled, range-partitioned suffix sort.

Every string of ``LENGTH`` bytes is a suffix cut to that length.  Sorting all of
them would move each byte a hundred times, so suffixes travel in groups:

1. Anchors.  The least hash of a ``GRAM``-byte string inside a window picks its
   anchor; equal windows pick the same place, and neighbouring windows mostly
   share it.  A run of windows with one anchor is one row of a few numbers.
2. Anchors that occur once have no repeated window.  Of rows with an equal
   anchor and an equal run (128 hashed bits), the earliest owns the run and
   all others are repeats; this needs no text and combines before the shuffle.
3. Anchors whose runs differ are compared as text.  Their owners' pieces are
   range-partitioned by the bytes that lead from the anchor, with splitters
   that Spark samples; for an anchor with more than ``HOT`` different runs the
   place in the corpus breaks ties, so none is too frequent to split.  Each
   bucket sorts its suffixes by multikey quicksort, eight bytes at a time, and
   the earliest of equal ones owns the string.  Suffixes of a split anchor that
   go on over a bucket's end, and own their string in it, are compared across
   the boundary by an aggregation on the string.
4. A repeated string marks its bytes; texts are cut where they are joined with
   their marks.

Repeats inside one document are settled where the document is read, so neither
a long run of one character nor a repeated line sends more than one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, materialize
from wardline.llm.shingles import mix

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
SEGMENT = 1 << 22
HOT = 1_000
U = np.uint64
_M = U(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = U((1 << 24) - 1)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _M + y
    return z ^ (z >> U(29))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, n, off, a, s) of the runs of windows that share an anchor:
    ``n`` windows from byte ``start``, the anchor ``off`` bytes later, with the
    hashes of the anchor's bytes and of all bytes of the run."""
    parts = []
    batch, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), SEGMENT):
            piece = t[at:at + SEGMENT + LENGTH - 1]
            if size + len(piece) > SEGMENT // 4 and batch:
                parts.append(_anchors(batch))
                batch, size = [], 0
            batch.append((i, at, piece))
            size += len(piece)
    if batch:
        parts.append(_anchors(batch))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _anchors(batch: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    sizes = np.array([len(p) for _, _, p in batch])
    ends = np.cumsum(sizes)
    h = {1: _BYTE[b]}
    for m in (1, 2, 4, 8, 16, 32):
        h[2 * m] = _join(h[m][:-m], h[m][m:])
    g = h[GRAM]
    low = (mix(g) & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    step = 1
    while 2 * step <= WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:len(low) - (WINDOW - step)], low[WINDOW - step:])
    at = (low & _PLACE).astype(np.int64)
    # windows that end inside their piece
    ok = np.zeros(len(at), bool)
    for e, n in zip(ends, sizes):
        ok[e - n:e - LENGTH + 1] = True
    p = np.flatnonzero(ok)
    q, owner = at[p], np.searchsorted(ends, p, side="right")
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(p)]]))
    start, owner, q = p[first], owner[first], q[first]
    last = start + n - 1

    def whole(x):
        return _join(_join(h[64][x], h[32][x + 64]), h[4][x + 96])
    s = mix(whole(start) + mix(whole(last) + n.astype(np.uint64)))
    index = np.array([i for i, _, _ in batch])
    base = np.array([a for _, a, _ in batch])
    return index[owner], base[owner] + start - (ends - sizes)[owner], n, q - start, g[q], s


def first_in_text(text: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether each run is the first with its hashes in its text."""
    order = np.lexsort((np.arange(len(a)), s, a, text))
    t, x, y = text[order], a[order], s[order]
    out = np.ones(len(a), bool)
    out[order[1:]] = (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return out


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of rows of 64-bit words: sorted by the first word, then
    only tied rows by the next, and so on; ``group`` numbers equal rows."""
    n = len(rows)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)
    for c in range(rows.shape[1]):
        keys = rows[order[live], c]
        by = np.lexsort((keys, group[live]))
        order[live] = order[live][by]
        keys, g = keys[by], group[live]
        edge = np.concatenate([[True], (g[1:] != g[:-1]) | (keys[1:] != keys[:-1])])
        group[live] = np.maximum.accumulate(np.where(edge, live, 0))
        ties = ~edge | np.concatenate([~edge[1:], [False]])
        live = live[ties]
        if not len(live):
            break
    return order, group


def words(buf: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes from each start as big-endian words, padded with zeros."""
    n = -(-size // 8) * 8
    out = buf[starts[:, None] + np.arange(n)]
    out[:, size:] = 0
    return out.view(">u8").astype(np.uint64)


ROWS = "doc long, print long, a long, s long, loc long"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc, print, a, s, loc) of each document's distinct runs; ``loc`` packs
    start, n and off."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, start, n, off, a, s = anchors([bytes(x) for x in b["bytes"]])
            keep = first_in_text(t, a, s)
            t, start, n, off, a, s = (x[keep] for x in (t, start, n, off, a, s))
            yield pd.DataFrame({"doc": b["doc"].to_numpy()[t], "print": b["print"].to_numpy()[t], "a": a.view(np.int64),
                                "s": s.view(np.int64), "loc": (start << 14) | (n << 7) | off})
    return docs.mapInPandas(run, ROWS)


def numbered(df: DataFrame) -> DataFrame:
    """(doc, print, bytes): the id (rows without one come last), a hash of the
    text to tell rows of one id apart, and the text as bytes."""
    d = documents(df)
    return d.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("print"),
                    F.col("text").cast("binary").alias("bytes"))


def pieces(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """(doc, print, loc, hot, piece): the bytes of the runs in
    ``owners(doc, print, loc, hot)``."""
    per_doc = owners.groupBy(F.col("doc").alias("d"), F.col("print").alias("p")).agg(
        F.collect_set(F.struct("loc", "hot")).alias("locs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, mark, text, locs in zip(b["doc"], b["print"], b["bytes"], b["locs"]):
                text = bytes(text)
                for x in locs:
                    start, n = int(x["loc"]) >> 14, (int(x["loc"]) >> 7) & 127
                    rows.append((doc, mark, x["loc"], x["hot"], text[start:start + n + LENGTH - 1]))
            yield pd.DataFrame(rows, columns=["doc", "print", "loc", "hot", "piece"])

    joined = docs.join(per_doc, (F.col("doc") == F.col("d")) & (F.col("print") == F.col("p"))).select("doc", "print", "bytes", "locs")
    joined = joined.dropDuplicates(["doc", "print"])
    return joined.mapInPandas(run, "doc long, print long, loc long, hot boolean, piece binary")


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes that each row of ``x`` has in common with ``y`` from the left."""
    return np.cumprod(x == y, axis=1).sum(axis=1)


def _bucket(doc: np.ndarray, mark: np.ndarray, loc: np.ndarray, hot: np.ndarray, piece: list[bytes]) -> Iterator[pd.DataFrame]:
    """Sort one bucket.  Rows of kind 0 are runs of repeated windows; rows of
    kind 1 are windows of split anchors that own their string in this bucket
    but may have equals in another: what follows the anchor in them is also
    what follows it in the bucket's first or last row."""
    start, n, off = loc >> 14, (loc >> 7) & 127, loc & 127
    size = np.array([len(x) for x in piece])
    base = np.cumsum(size) - size
    buf = np.concatenate([np.frombuffer(b"".join(piece), np.uint8), np.zeros(LENGTH + 8, np.uint8)])
    order, group = multikey_sort(words(buf, base + off, GRAM))
    edge = ((group == group[0]) | (group == group[-1])) & hot[order]
    ends = np.full(len(order), -1)  # bytes after the anchor shared with the bucket's ends
    if edge.any():
        leads = buf[(base + off)[:, None] + np.arange(LENGTH)]
        sizes = np.minimum(size - off, LENGTH)
        leads[np.arange(LENGTH) >= sizes[:, None]] = 0
        mine = order[edge]
        by = np.lexsort(leads[mine].T[::-1])
        for i in (mine[by[0]], mine[by[-1]]):
            ends[mine] = np.maximum(ends[mine], _shared(leads[mine], leads[i]))
    cuts = np.flatnonzero(np.diff(group)) + 1
    lo = 0
    total = np.cumsum(n[order])
    while lo < len(order):
        # whole anchors of about 100,000 windows together
        want = np.searchsorted(total, (total[lo - 1] if lo else 0) + 100_000)
        k = np.searchsorted(cuts, max(want, lo + 1))
        hi = int(cuts[k]) if k < len(cuts) else len(order)
        rows = order[lo:hi]
        row = np.repeat(rows, n[rows])
        j = np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        at_edge = np.repeat(edge[lo:hi], n[rows])
        w, o = start[row] + j, base[row] + j
        by, same = multikey_sort(words(buf, o, LENGTH))
        row, w, o, at_edge = row[by], w[by], o[by], at_edge[by]
        rank = np.lexsort((w, doc[row], same))
        own = np.zeros(len(row), bool)
        own[rank[np.concatenate([[True], np.diff(same[rank]) != 0])]] = True
        # of a window, the anchor lies off - j bytes in, and the rest follows it
        after = LENGTH - (off[row] - (w - start[row]))
        open_ = own & at_edge & (ends[row] >= after)
        for x in range(0, int(open_.sum()), 50_000):
            y = np.flatnonzero(open_)[x:x + 50_000]
            yield pd.DataFrame({"kind": 1, "doc": doc[row[y]], "print": mark[row[y]], "wstart": w[y], "wn": 1,
                                "win": [bytes(buf[i:i + LENGTH]) for i in o[y]]})
        again = ~own
        row, w = row[again], w[again]
        if len(row):
            by = np.lexsort((w, row))
            row, w = row[by], w[by]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(w) != 1)]))
            yield pd.DataFrame({"kind": 0, "doc": doc[row[cut]], "print": mark[row[cut]], "wstart": w[cut],
                                "wn": np.diff(np.concatenate([cut, [len(row)]])), "win": None})
        lo = hi


def sort_buckets(made: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """(kind, doc, print, wstart, wn, win) of all buckets."""
    n = max(made.count() // rows_per_bucket + 1, int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    gram = F.expr(f"substring(piece, CAST((loc & 127) + 1 AS INT), {GRAM})")
    lead = F.expr(f"substring(piece, CAST((loc & 127) + 1 AS INT), {LENGTH})")
    key = F.struct(gram.alias("gram"), F.when(F.col("hot"), F.struct(lead.alias("lead"), "doc", "loc")).alias("place"))
    dealt = made.withColumn("key", key).repartitionByRange(n, "key.gram", "key.place").drop("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            b = pd.concat(got)
            yield from _bucket(b["doc"].to_numpy(), b["print"].to_numpy(), b["loc"].to_numpy(), b["hot"].to_numpy(bool), [bytes(x) for x in b["piece"]])

    return dealt.mapInPandas(run, "kind int, doc long, print long, wstart long, wn int, win binary")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, print, wstart, wn): runs of windows that start earlier elsewhere;
    repeats of a whole run inside one document are left out."""
    often = (anchor_rows(docs).groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select(F.col("a").alias("k")))
    some = materialize(anchor_rows(docs).join(often, F.col("a") == F.col("k")).drop("k"), "anchors")
    place = F.struct("doc", F.shiftright("loc", 14).alias("start"), "print", "loc")
    classes = materialize(some.groupBy("a", "s").agg(F.min(place).alias("own")), "classes")
    others = (some.join(classes, ["a", "s"])
              .where((F.col("doc") != F.col("own.doc")) | (F.shiftright("loc", 14) != F.col("own.start")))
              .select("doc", "print", F.shiftright("loc", 14).alias("wstart"), (F.shiftright("loc", 7).bitwiseAND(F.lit(127))).cast("int").alias("wn")))
    others = materialize(others, "repeats")
    mixed = classes.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select(F.col("a").alias("k"), (F.col("c") > HOT).alias("hot"))
    owners = classes.join(mixed, F.col("a") == F.col("k")).select("own.doc", "own.print", "own.loc", "hot")
    made = materialize(pieces(docs, owners), "pieces")
    sorted_ = materialize(sort_buckets(made), "buckets")
    ends = sorted_.where("kind = 1").select("doc", "print", "wstart", "win")
    first = ends.groupBy(F.col("win").alias("w")).agg(F.min(F.struct("doc", "wstart")).alias("own"))
    across = (ends.join(first, F.col("win") == F.col("w"))
              .where((F.col("doc") != F.col("own.doc")) | (F.col("wstart") != F.col("own.wstart")))
              .select("doc", "print", "wstart", F.lit(1).alias("wn")))
    return others.unionByName(sorted_.where("kind = 0").select("doc", "print", "wstart", "wn")).unionByName(across)


def marked_bytes(texts: list[bytes], runs: list) -> list[np.ndarray]:
    """For each text, which bytes repeated windows cover: the given runs, and
    whole runs found again in the same text."""
    t, start, n, _, a, s = anchors(texts)
    again = ~first_in_text(t, a, s)
    t, start, n = t[again], start[again], n[again]
    bounds = np.searchsorted(t, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        edge = np.zeros(len(text) + 1, np.int32)
        lo, hi = bounds[i], bounds[i + 1]
        np.add.at(edge, start[lo:hi], 1)
        np.add.at(edge, start[lo:hi] + n[lo:hi] + LENGTH - 1, -1)
        if runs[i] is not None and len(runs[i]):
            w = np.array([r["wstart"] for r in runs[i]], np.int64)
            k = np.array([r["wn"] for r in runs[i]], np.int64)
            np.add.at(edge, w, 1)
            np.add.at(edge, w + k + LENGTH - 1, -1)
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def remove_repeats(df: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    A byte goes if a string of LENGTH bytes covers it that also starts earlier:
    in a document with a smaller id, or before in the same one.  Null and texts
    shorter than LENGTH lose nothing.  Rows that repeat an id count as one
    document, so none of them starts earlier than its copy; rows without an id
    come after all others and count as one document too."""
    docs = numbered(df)
    runs = (repeated(docs).groupBy(F.col("doc").alias("d"), F.col("print").alias("p"))
            .agg(F.collect_set(F.struct("wstart", "wn")).alias("runs")))
    joined = docs.join(runs, (F.col("doc") == F.col("d")) & (F.col("print") == F.col("p")), "left").select("doc", "bytes", "runs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [bytes(x) for x in b["bytes"]]
            rows = []
            for text, gone in zip(texts, marked_bytes(texts, list(b["runs"]))):
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
            yield pd.DataFrame(rows, columns=cols).assign(doc=b["doc"].to_numpy())[["doc", *cols]]

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    out = joined.mapInPandas(run, schema)
    return out.withColumn("doc_id", F.when(F.col("doc") < (1 << 63) - 1, F.col("doc"))).drop("doc").select(
        "doc_id", *[c for c in out.columns if c != "doc"])
