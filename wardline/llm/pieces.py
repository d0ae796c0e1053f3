"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice over a text has one node per code point boundary and one arc per
vocabulary piece.  An arc survives if the piece may follow the last piece of
the best path to its start, that is, if merging the two pieces' text by rank
gives back exactly these two; every node then keeps one backpointer, and the
path it spells is the model's own segmentation.  Only the nodes within the
longest piece's length are held: as soon as the backpointers of all of them
lead to one boundary, the ids up to it are committed.

A space that follows another character is such a boundary in every path, since
no piece has an inner space; so is a change between letters and other characters,
if the vocabulary has no piece across one.  So the window restarts at each of
them, and what it committed for the stretch between two is remembered, up to a
bound: words repeat, and a stretch passes the window only if it is not remembered.  Characters without
a piece become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, per_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: The same, cut between letters and other characters too.
FINER = re.compile(rf"{SPACE}*[^\W\d_¹²³]+|{SPACE}*(?:[^\w{SPACE}]|[\d_¹²³])+|{SPACE}+")
REMEMBERED = 200_000
#: Characters of a stretch whose nodes are remembered beside.
BEGINNING = 6


class Pieces:
    """Encoder and decoder for one model file; ``path`` must be readable by
    the tasks."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {v: k for k, v in self.byte.items()}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.id))
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has an inner space; units can't be cut at spaces")
        # boundaries in every path: no piece has letters next to other characters (but spaces before them)
        self.cuts = FINER if all(FINER.fullmatch(p) for p in self.id) else UNIT
        self._trie: dict = {}  # by character; under "" the piece that ends there
        for p in self.id:
            node = self._trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self._ends: dict = {}  # the same from each piece's last character backwards
        for p in self.id:
            node = self._ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self._begun: dict[str, list] = {}
        self._fits: dict[str, dict[str, bool]] = {}
        self._n_fits = 0
        self._plain = [None if i in self.byte_of else t for i, t in enumerate(self.text)]
        self.known = Known(self)

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-ranked pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether piece ``b`` may follow piece ``a``."""
        if self._n_fits >= 2 * REMEMBERED:
            self._fits.clear()
            self._n_fits = 0
        ok = self._fits.setdefault(a, {})[b] = self.merge(a + b) == [a, b]
        self._n_fits += 1
        return ok

    def extend(self, buf: str, back: list, i: int) -> None:
        """Let the path that ends at node ``i`` reach the nodes after it."""
        last, node = back[i], self._trie
        known = self._fits.get(last, {}) if last in self.id else None
        for j in range(i, len(buf)):
            node = node.get(buf[j])
            if node is None:
                break
            if back[j + 1] is None and (s := node.get("")) is not None:
                ok = True
                if known is not None and (ok := known.get(s)) is None:
                    ok = self.fits(last, s)
                    known = self._fits[last]
                if ok:
                    back[j + 1] = s
        if back[i + 1] is None and buf[i] not in self.id:
            back[i + 1] = buf[i]  # a character without a piece stands alone

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.byte.get(x, self.unknown) for x in piece.encode()]

    def stream(self, chars: Iterator[str]) -> Iterator[list[str]]:
        """Viterbi over a stream of characters: yields committed pieces.

        ``back[j - base]`` is the piece that ends at node j on its only
        surviving path, None if no path ends there."""
        buf, base, back = "", 0, [""]  # text and backpointers since the committed boundary
        pending, ended = iter(chars), False
        front = 0  # the next node to extend
        while True:
            while not ended and len(buf) < front - base + self.longest:
                c = next(pending, "")
                ended = not c
                buf += c
                back += [None] * len(c)
            if front - base >= len(buf):
                break
            if back[front - base] is not None:
                self.extend(buf, back, front - base)
            front += 1
            if front - base >= 4 * self.longest:
                # nodes ahead of the front can only be reached from the last `longest` nodes
                cut = self._common(back, [j for j in range(front - base, min(front - base + self.longest, len(back)))
                                          if back[j] is not None])
                if cut:
                    yield self._path(back, cut)
                    back = [back[cut], *back[cut + 1:]]
                    buf, base = buf[cut:], base + cut
        if buf:
            yield self._path(back, len(buf))

    def arrive(self, chars: str, j: int, back: list) -> str | None:
        """The piece by which the path to node ``j`` arrives, from the nodes
        before: the only arc that may follow the path to its start."""
        node, fits = self._ends, self._fits
        for i in range(j - 1, -1, -1):
            node = node.get(chars[i])
            if node is None:
                break
            s = node.get("")
            if s is None or (last := back[i]) is None:
                continue
            if not i or last not in self.id:
                return s
            known = fits.get(last)
            ok = known.get(s) if known is not None else None
            if self.fits(last, s) if ok is None else ok:
                return s
        if chars[j - 1] not in self.id and back[j - 1] is not None:
            return chars[j - 1]  # a character without a piece stands alone
        return None

    def within(self, chars: str) -> list[str]:
        """The pass of :meth:`stream` over a text that fits the window whole.
        The nodes of its first characters are those of every text that begins
        so, and are remembered."""
        n, m = len(chars), min(BEGINNING, len(chars))
        begun = self._begun.get(chars[:m])
        if begun is None:
            begun = [""]
            for j in range(1, m + 1):
                begun.append(self.arrive(chars, j, begun))
            if len(self._begun) >= REMEMBERED:
                self._begun.clear()
            self._begun[chars[:m]] = begun
        back = begun[:]
        for j in range(m + 1, n + 1):
            back.append(self.arrive(chars, j, back))
        return self._path(back, n)

    @staticmethod
    def _common(back: list, live: list[int]) -> int:
        """The last boundary on the paths of all live nodes."""
        nodes = set(live)
        while len(nodes) > 1:
            j = max(nodes)
            nodes.discard(j)
            nodes.add(j - len(back[j]) if j else 0)
        return nodes.pop() if nodes else 0

    @staticmethod
    def _path(back: list, j: int) -> list[str]:
        out = []
        while j > 0:
            out.append(back[j])
            j -= len(back[j])
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, committed stretch by stretch."""
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, UNIT.findall(SPACE + text.replace(" ", SPACE)))), np.int32)

    def decode(self, ids) -> str:
        try:
            t = "".join(map(self._plain.__getitem__, ids))
        except TypeError:  # byte pieces among them
            parts, raw = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                parts.append(self.text[i])
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
            t = "".join(parts)
        t = t.replace(SPACE, " ")
        return t[1:] if t.startswith(" ") else t


class Known(dict):
    """Ids, as bytes, of the stretches that the window has passed: a stretch
    that is not here goes through the window.  Of the ``REMEMBERED`` before, those
    that come again are taken over."""

    def __init__(self, model: Pieces):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, stretch: str) -> bytes:
        m = self.model
        if len(stretch) > 4 * m.longest:  # more than the window holds
            return array("i", [i for part in m.stream(iter(stretch)) for p in part for i in m.ids_of(p)]).tobytes()
        out = self.older.get(stretch)
        if out is None:
            get = m.id.get
            ids: list[int] = []
            for p in m.within(stretch):
                i = get(p)
                if i is None:
                    ids += m.ids_of(p)
                else:
                    ids.append(i)
            out = array("i", ids).tobytes()
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[stretch] = out
        return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str = MODEL) -> Pieces:
    """One instance per worker, so remembered units serve all its tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for every row, over whole texts.

    Null and empty texts have no ids.  ``round_trip`` says whether decoding
    gives back the text; it does unless the text itself has U+2581 (the space
    mark), which decodes to a space."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for b in batches:
            for lo in range(0, len(b), 256):  # ids leave the task soon
                part = b.iloc[lo:lo + 256]
                ids = [p.encode(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(x) for x in ids], "ids": pd.Series(ids, dtype=object, index=part.index),
                                    "round_trip": [p.decode(x.tolist()) == t for x, t in zip(ids, part["text"])]})

    d = documents(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = d.mapInPandas(run, "doc_id string, n_tokens long, ids array<int>, round_trip boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    def make():
        p = pieces(path)
        return lambda ids: (p.decode([] if ids is None else list(ids)),)

    return per_text(encoded.select("doc_id", F.col("ids").alias("text")), None, "text string", make)
