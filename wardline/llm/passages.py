"""Removal of repeated passages by suffix automata of reference shards.

The reference is the corpus itself: of each string of ``length`` words that is
found twice, the text around its earliest place.  Streaming every document
against all of that would be quadratic, so hashes choose what is streamed where,
and the automata, which compare words, decide what goes.

1. Anchors.  The least hash of a few words inside a window picks its anchor, so
   equal windows have equal anchors.  Documents give each of their anchors once,
   with its count; one that occurs once belongs to no repeated window.
2. Segments.  Documents that hold other anchors give the stretches of text
   around them, and their runs of windows with one anchor.  Equal runs become
   one class.  An anchor with one class repeats it whole; only where classes
   differ are their windows counted.  The earliest segment with a window that
   occurs again is reference text.
3. Shards.  Reference segments are dealt into shards of about ``SHARD`` words.
   A class knows the shards of its windows, so a segment is routed to the
   shards that hold the first places of its windows, and to no others.
4. A shard is sent to as many tasks as its stream needs, about ``STREAM`` words
   to each.  There it becomes a suffix automaton, built in the order of the
   corpus, so each state knows the earliest place of its strings.  The segments
   stream through it for their matching statistics: where the longest match that
   ends at a word has ``length`` words or more and starts earlier in the corpus,
   the window goes, and neighbouring windows are one span.
5. Texts are joined with their spans and cut.

Nothing is gathered per anchor, class or window but sums and least places, and
the lists that are gathered belong to one document or one class of a few words.
Sending all shards everywhere, as one broadcast, would have no bound; so each is
sent only to the tasks that stream against it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, materialize
from wardline.llm.shingles import chunks, mix

PIECE = 4096       # windows of one segment; longer stretches are cut, and overlap by a window
SHARD = 32_768
STREAM = 262_144
KEY = ["late", "doc", "print"]
U = np.uint64
_M, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = U((1 << 24) - 1)


@cache
def _power_table(x: int, n: int) -> np.ndarray:
    out = np.full(n, U(x))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers(x: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those of a usual chunk are kept."""
    usual = 1 << 21
    return _power_table(x, usual)[:n] if n <= usual else _power_table.__wrapped__(x, n)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * U(_M) + y
    return z ^ (z >> U(29))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, text, first byte, byte after the last) of every word."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + U(1)) * _powers(_M, len(b)), out=total[1:])
    h = mix(((total[last] - total[first]) * _powers(_INVERSE, len(b))[first]) ^ mix((last - first).astype(np.uint64)))
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, first, side="right")
    begin = ends - [len(t) + 1 for t in texts]
    return h, of, first - begin[of], last - begin[of]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive ones."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, level = None, 0, 1, h
    while True:
        if n & size:
            part = level[at:at + m]
            out = part if out is None else _join(out, part)
            at += size
        size *= 2
        if size > n:
            return out
        level = _join(level[:-(size // 2)], level[size // 2:])


def anchors(h: np.ndarray, of: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first word, anchor's place, anchor) of every window inside one text."""
    gram = max(1, length * 3 // 10)
    g = rolled(h, gram)
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    low = (mix(g) & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    at = np.flatnonzero(of[:len(low)] == of[length - 1:])
    q = (low[at] & _PLACE).astype(np.int64)
    return at, q, g[q]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def numbered(df: DataFrame) -> DataFrame:
    """(late, doc, print, text): whether the id is missing, the id, and a hash
    that tells apart the texts of one id."""
    d = documents(df)
    return d.select(F.col("doc_id").isNull().cast("int").alias("late"), F.coalesce("doc_id", F.lit(0)).alias("doc"),
                    F.xxhash64("text").alias("print"), "text")


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(late, doc, print, a, c): the anchors of each text, and how many of its
    stretches of windows have each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() for t in b["text"]]
            for lo, hi in chunks(texts):
                h, of, _, _ = words_of(texts[lo:hi])
                at, q, a = anchors(h, of, length)
                new = _edges(q)  # places tell texts apart too
                t, a = of[at[new]], a[new]
                by = np.lexsort((a, t))
                t, a = t[by], a[by]
                new = np.flatnonzero(_edges(t, a))
                keys = {k: b[k].to_numpy()[lo:hi][t[new]] for k in KEY}
                yield pd.DataFrame({**keys, "a": a[new].view(np.int64), "c": np.diff(np.append(new, len(t)))})
    return docs.mapInPandas(run, "late int, doc long, print long, a long, c long")


RUN = "late int, doc long, print long, seg long, start long, n long, a long, s long, c long, words long, text string"


def stretches(docs: DataFrame, live: DataFrame, length: int) -> DataFrame:
    """Rows of two kinds for the texts in ``live(late, doc, print, anchors)``.

    Runs (``text`` is null): ``n`` windows of one segment with one anchor, from
    word ``start``: anchor, hash of the run, how often the segment has it.
    Segments: ``seg`` is their first word, with their text and word count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() for t in b["text"]]
            wanted = [np.asarray(x, np.int64).view(np.uint64) for x in b["anchors"]]
            for lo, hi in chunks(texts):
                for table in _stretches(texts[lo:hi], wanted[lo:hi], length):
                    t = table.pop("t")
                    yield pd.DataFrame({**{k: b[k].to_numpy()[lo:hi][t] for k in KEY}, **table})

    return docs.join(live, KEY).select(*KEY, "text", "anchors").mapInPandas(run, RUN)


def _stretches(texts: list[bytes], wanted: list[np.ndarray], length: int) -> list[dict]:
    h, of, first, last = words_of(texts)
    at, q, a = anchors(h, of, length)
    window = rolled(h, length)
    # anchor and text together: membership of all texts at once
    asked = np.concatenate([mix(w + mix(np.full(len(w), i + 1, np.uint64))) for i, w in enumerate(wanted)])
    live = np.isin(mix(a + mix((of[at] + 1).astype(np.uint64))), asked)
    at, q, a = at[live], q[live], a[live]
    if not len(at):
        return []
    t = of[at]
    word0 = np.searchsorted(of, np.arange(len(texts)))  # of each text
    # stretches of consecutive windows, cut into pieces
    begin = np.maximum.accumulate(np.where(_edges(t, at - np.arange(len(at))), np.arange(len(at)), 0))
    nth = (np.arange(len(at)) - begin) // PIECE
    new = _edges(begin, nth)
    piece = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    seg = at[head] - word0[t[head]]
    tp = t[head]
    out = [{"t": tp, "seg": seg, "start": seg, "n": 0, "a": 0, "s": 0, "c": 0, "words": at[tail] - at[head] + length,
            "text": [texts[i][first[x]:last[y + length - 1]].decode() for i, x, y in zip(tp, at[head], at[tail])]}]
    run = np.flatnonzero(_edges(piece, q))
    n = np.diff(np.append(run, len(at)))
    w0, w1 = at[run], at[run + n - 1]
    s = mix(window[w0] + mix(window[w1] + n.astype(np.uint64)))  # at most ``length`` windows: the two cover all words
    by = np.lexsort((w0, s, a[run], piece[run]))
    firsts = np.flatnonzero(_edges(piece[run][by], a[run][by], s[by]))
    keep, count = by[firsts], np.diff(np.append(firsts, len(by)))
    out.append({"t": t[run][keep], "seg": seg[piece[run][keep]], "start": (w0 - word0[t[run]])[keep], "n": n[keep],
                "a": a[run][keep].view(np.int64), "s": s[keep].view(np.int64), "c": count, "words": 0, "text": None})
    return out


def window_rows(segments: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(a, s, c, h, late, doc, start, seg, print): the windows of the classes
    ``(a, s, n, c, own)``, hashed from the text of their first places."""
    asked = classes.groupBy(*[F.col(f"own.{k}").alias(k) for k in [*KEY, "seg"]]).agg(
        F.collect_list(F.struct("a", "s", "n", "c", F.col("own.start").alias("start"))).alias("runs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() for t in b["text"]]
            for lo, hi in chunks(texts):
                h, of, _, _ = words_of(texts[lo:hi])
                window, word0 = rolled(h, length), np.searchsorted(of, np.arange(hi - lo))
                runs = list(b["runs"].iloc[lo:hi])
                t = np.repeat(np.arange(hi - lo), [len(x) for x in runs])
                a, s, n, c, start = (np.array([r[k] for x in runs for r in x], np.int64) for k in ("a", "s", "n", "c", "start"))
                row = np.repeat(np.arange(len(t)), n)
                j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                seg = b["seg"].to_numpy()[lo:hi][t]
                w = start[row] + j
                keys = {k: b[k].to_numpy()[lo:hi][t][row] for k in KEY}
                yield pd.DataFrame({"a": a[row], "s": s[row], "c": c[row], "h": window.view(np.int64)[word0[t[row]] + w - seg[row]],
                                    **keys, "start": w, "seg": seg[row]})

    return (segments.join(asked, [*KEY, "seg"]).select(*KEY, "seg", "text", "runs")
            .mapInPandas(run, "a long, s long, c long, h long, late int, doc long, print long, start long, seg long"))


class Automaton:
    """Suffix automaton of several word sequences, given in the order of the
    corpus: ``first`` of a state is the place of its strings' earliest end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        self.ids: dict[bytes, int] = {}
        self.end = 0

    def add(self, words: list[bytes]) -> None:
        nxt, link, size, first, ids = self.next, self.link, self.size, self.first, self.ids

        def split(p: int, c: int, q: int) -> int:
            """A copy of state q for the strings that end a string of p and c."""
            clone = len(nxt)
            nxt.append(nxt[q].copy())
            link.append(link[q])
            size.append(size[p] + 1)
            first.append(first[q])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        state = 0
        for w in words:
            c = ids.setdefault(w, len(ids))
            q = nxt[state].get(c)
            if q is not None:  # the sequence so far, and this word, were there before
                state = q if size[q] == size[state] + 1 else split(state, c, q)
            else:
                new, p = len(nxt), state
                nxt.append({})
                link.append(0)
                size.append(size[state] + 1)
                first.append(self.end)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if size[q] == size[p] + 1 else split(p, c, q)
                state = new
            self.end += 1

    def matches(self, words: list[bytes], length: int) -> Iterator[tuple[int, int]]:
        """(place in ``words``, earliest place in the automaton) of the last word
        of each window of ``length`` words that the automaton holds.  The match
        is kept no longer than ``length``, so its state has the window itself."""
        nxt, link, size, first, get = self.next, self.link, self.size, self.first, self.ids.get
        state, n = 0, 0
        for i, w in enumerate(words):
            c = get(w)
            q = nxt[state].get(c)
            while q is None and state:
                state = link[state]
                n = size[state]
                q = nxt[state].get(c)
            if q is None:
                n = 0
                continue
            state, n = q, n + 1
            if n >= length:
                while size[link[state]] >= length:
                    state = link[state]
                n = length
                yield i, first[state]


def stream(reference: pd.DataFrame, segments: pd.DataFrame, length: int) -> pd.DataFrame:
    """(late, doc, print, wstart, wn): spans of windows of ``segments`` that start
    earlier in ``reference``."""
    rows = []
    if len(reference) and len(segments):
        auto, places = Automaton(), []  # places: end of the passage so far, late, doc, what to add to get the word
        for late, doc, seg, text in reference.sort_values(["late", "doc", "seg"])[["late", "doc", "seg", "text"]].itertuples(index=False):
            begin = auto.end
            auto.add(text.encode().split())
            places.append((auto.end, late, doc, seg - begin))
        ends = np.array([p[0] for p in places])
        for late, doc, mark, seg, text in segments[[*KEY, "seg", "text"]].itertuples(index=False):
            found = list(auto.matches(text.encode().split(), length))
            if not found:
                continue
            i, e = np.array(found).T
            owner = np.searchsorted(ends, e, side="right")
            lates, docs, shift = (np.array([places[k][x] for k in owner]) for x in (1, 2, 3))
            start, own = seg + i - length + 1, e + shift - length + 1
            gone = start[(lates < late) | ((lates == late) & ((docs < doc) | ((docs == doc) & (own < start))))]
            cut = np.flatnonzero(np.diff(gone, prepend=-2) != 1)
            rows += [(late, doc, mark, int(gone[x]), int(n)) for x, n in zip(cut, np.diff(np.append(cut, len(gone))))]
    return pd.DataFrame(rows, columns=[*KEY, "wstart", "wn"])


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """(late, doc, print, wstart, wn) of the windows that also start earlier."""
    rows = materialize(anchor_rows(docs, length), "anchors")
    often = rows.groupBy("a").agg(F.sum("c").alias("all")).where(F.col("all") > 1).select("a")
    live = rows.join(often, "a").groupBy(*KEY).agg(F.collect_set("a").alias("anchors"))
    parts = materialize(stretches(docs, live, length), "stretches")
    segments = parts.where("text IS NOT NULL").select(*KEY, "seg", "words", "text").dropDuplicates([*KEY, "seg"])
    runs = parts.where("text IS NULL")

    place = F.struct("late", "doc", "start", "seg", "print")
    classes = runs.groupBy("a", "s").agg(F.min(place).alias("own"), F.first("n").alias("n"), F.sum("c").alias("c"))
    classes = materialize(classes, "classes")
    several = classes.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
    one = classes.join(several, "a", "left_anti")  # the whole class is repeated
    windows = materialize(window_rows(segments, classes.join(several, "a"), length), "windows")
    twice = windows.groupBy("a", "h").agg(F.min(place).alias("own"), F.sum("c").alias("c")).where(F.col("c") > 1).select("a", "h", "own")
    twice = materialize(twice, "repeated")

    owners = one.select("own").unionByName(twice.select("own"))
    firsts = owners.select("own.late", "own.doc", "own.print", "own.seg").distinct()
    reference = materialize(segments.join(firsts, [*KEY, "seg"]), "reference")
    total = reference.agg(F.sum("words")).first()[0] or 0
    shards = -(-total // SHARD) or 1

    def shard(prefix: str):
        return F.pmod(F.xxhash64(*[F.col(prefix + k) for k in KEY], F.floor(F.col(prefix + "seg") / SHARD)), F.lit(shards))

    some = (windows.join(twice.select("a", "h", shard("own.").alias("shard")), ["a", "h"])
            .groupBy("a", "s").agg(F.collect_set("shard").alias("shards")).withColumn("own", F.lit(None).cast(classes.schema["own"].dataType)))
    where = some.unionByName(one.select("a", "s", F.array(shard("own.")).alias("shards"), "own"))
    # the first place of a class that is repeated whole has nothing to lose
    first = F.lit(True)
    for k in (*KEY, "seg"):
        first = first & F.col(f"own.{k}").eqNullSafe(F.col(k))
    routes = (runs.join(where, ["a", "s"]).where(~first | (F.col("c") > 1))
              .select(*KEY, "seg", F.explode("shards").alias("shard")).distinct())
    streams = materialize(routes.join(segments, [*KEY, "seg"]), "streams")
    copies = streams.groupBy("shard").agg(F.ceil(F.sum("words") / STREAM).alias("copies"))
    needs = copies.select(F.col("shard").alias("of"), F.col("copies").alias("times"))
    left = (reference.withColumn("shard", shard("")).join(needs, F.col("shard") == F.col("of"))
            .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"), *KEY, "seg", "text"))
    right = (streams.join(copies, "shard")
             .select(F.col("shard").alias("to"), F.pmod(F.xxhash64(*KEY, "seg"), F.col("copies")).alias("part"), *KEY, "seg", "text"))
    return (left.groupBy("shard", "copy").cogroup(right.groupBy("to", "part"))
            .applyInPandas(lambda x, y: stream(x, y, length), "late int, doc long, print long, wstart long, wn long"))


def remove_passages(df: DataFrame, length: int = 20, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row.

    A word goes if a window of ``length`` words covers it whose words also start
    earlier: in a document with a smaller id, or before in the same one; windows
    are judged on the input.  ``kept`` joins the other words by one space.  Null,
    empty and shorter texts lose nothing.  Rows that repeat an id count as one
    document, so none of them starts earlier than its copy; rows without an id
    come after all others and count as one document too.  An empty table gives
    no rows; other columns are never read."""
    if length < 2:
        raise ValueError("a passage has two words at least")
    docs = numbered(df)
    # written, so that what the streams shuffled is gone before the texts move
    spans = materialize(repeated(docs, length).groupBy(*KEY).agg(F.collect_set(F.struct("wstart", "wn")).alias("spans")), "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, found in zip(b["text"], b["spans"]):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for x in found if found is not None else ():
                    edge[x["wstart"]] += 1
                    edge[x["wstart"] + x["wn"] + length - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
            cols = ["n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]
            yield pd.DataFrame({"late": b["late"], "doc": b["doc"],
                                **{c: pd.Series([r[i] for r in rows], index=b.index, dtype=object) for i, c in enumerate(cols)}})

    schema = "late int, doc long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    out = docs.join(spans, KEY, "left").select("late", "doc", "text", "spans").mapInPandas(run, schema)
    return out.select(F.when(F.col("late") == 0, F.col("doc")).alias("doc_id"), *[c for c in out.columns if c not in ("late", "doc")])
