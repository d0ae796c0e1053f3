"""Secret scan: fixed patterns, and password guess cost in credential contexts.

The dictionary is the words of the corpus itself, ranked by how often they
occur, besides a short list of usual passwords; a word costs its rank.  A value
that follows a credential word is segmented at minimum cost into words, dates, repeats, keyboard walks and brute-force spans (a
dynamic programme over its positions).  A brute-force span costs its length
times the bits of one alphabet that holds all its characters, and the choice of
that alphabet.  The cost is the base-2 logarithm of the guesses an attacker
needs; a value that costs at least ``min_bits`` is a secret, a guessable one
("password: summer2019") is not.

Offsets are code points, end exclusive; null text has no span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, per_text

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: A credential word, an assignment, and the value up to white space or a quote.
CONTEXT = re.compile(r"""(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|bearer|(?:api|access|private|auth)[_\x20-]?key)"""
                     r"""["']?(?:\x20*[:=]\x20*|\x20(?i:is)\x20)["'(]?([^\s"'<>]+)""", re.ASCII)
#: What every match of ASSIGN or CONTEXT holds, in lower case.
CREDENTIAL = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "bearer", "key")
HEX_MARK = bytes(48 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
HEX_RUN = b"0" * 16
TRAILING = ".,;:!?)]}"

WORDS = ("password secret admin welcome monkey dragon master login letmein qwerty abc iloveyou sunshine princess "
         "football shadow superman michael test guest root user default changeme hello spring summer autumn winter "
         "love baby angel hunter soccer batman trustno freedom whatever computer internet server service the and of "
         "in on to for with is as at by this that from not all my your none null true false example placeholder token "
         "key value string insert here").split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
LEET = str.maketrans("013457@$!", "oieastasi")
#: Bits of a usual password word, by its place in the list.
RANK = {w: math.log2(k + 2) for k, w in enumerate(dict.fromkeys(WORDS))}
#: Corpus words of the dictionary at most, how often each must occur, and their letters.
MAX_WORDS, MIN_COUNT, LETTERS = 50_000, 20, re.compile("[a-z]+")
SHORTEST, LONGEST = 3, 20
NEXT = {p for row in ROWS for r in (row, row[::-1]) for p in zip(r, r[1:])}


#: Sizes of the character classes: small, capital, digit, ASCII sign, other.
SIZES = (26, 26, 10, 33, 100)
SMALL, CAPITAL = 0, 1
#: Bits of a character of each union of classes, by the mask of its classes.
UNITED = [math.log2(max(1, sum(n for k, n in enumerate(SIZES) if mask >> k & 1))) for mask in range(1 << len(SIZES))]
#: Bits to choose one of the 31 unions, or a capital followed by small letters.
CHOICE = math.log2(len(UNITED))
#: 40 bits of characters, and the choice of their alphabet.
MIN_BITS = 40 + CHOICE


def _class(c: str) -> int:
    return 2 if c.isdigit() else 4 if not c.isascii() else 3 if not c.isalpha() else SMALL if c.islower() else CAPITAL


def _alphabet(c: str) -> float:
    return math.log2(SIZES[_class(c)])


class Guesser:
    """Guess costs over one dictionary {word: bits}."""

    def __init__(self, rank: dict[str, float]):
        self.rank, self.longest = rank, max(map(len, rank), default=0)
        self._known: dict[str, float] = {}

    def bits(self, value: str) -> float:
        got = self._known.get(value)
        if got is None:
            if len(self._known) >= 50_000:
                self._known.clear()
            got = self._known[value] = least_bits(value, self.rank, self.longest)
        return got


def least_bits(value: str, rank: dict[str, float], longest: int) -> float:
    """Least log2 guesses over all segmentations of ``value``; 0 if empty.

    Every segment after the first adds one bit for its place."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    # the run of equal characters and the keyboard walk that end at each position
    same, walk = [1] * n, [1] * n
    for i in range(1, n):
        same[i] = same[i - 1] + 1 if value[i] == value[i - 1] else 1
        walk[i] = walk[i - 1] + 1 if (low[i - 1], low[i]) in NEXT else 1
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := DATE.match(low, i)):
            dates.setdefault(m.end(), []).append(i)
    best = [0.0] * (n + 1)
    classes = [_class(c) for c in value]
    present = sum(1 << k for k in set(classes))
    # the cheapest open brute-force span over each alphabet, and of a capital and small letters
    spans, title = {mask: math.inf for mask in range(1, present + 1) if mask & present == mask}, math.inf
    for j in range(1, n + 1):
        k, start = classes[j - 1], best[j - 1] + CHOICE + (j > 1)
        for mask, cost in spans.items():
            spans[mask] = min(cost, start) + UNITED[mask] if mask >> k & 1 else math.inf
        title = (start if k == CAPITAL else title if k == SMALL else math.inf) + UNITED[1 << SMALL]
        cost = min(title, *spans.values())
        for m in range(SHORTEST, min(longest, j) + 1):
            if (r := rank.get(plain[j - m:j])) is not None:
                part = value[j - m:j]
                r += 0 if part == low[j - m:j] else 1 if part.isupper() or part.istitle() else m / 2
                cost = min(cost, best[j - m] + r + (plain[j - m:j] != low[j - m:j]) + (j > m))
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + math.log2(365 * 120 if j - i > 4 else 120) + (i > 0))
        # the whole run, or walk, that ends here: shorter ones cost at least as much
        if (m := same[j - 1]) >= 3:
            cost = min(cost, best[j - m] + _alphabet(value[j - 1]) + math.log2(m) + (j > m))
        if (m := walk[j - 1]) >= 3:
            cost = min(cost, best[j - m] + math.log2(2 * sum(map(len, ROWS))) + math.log2(m) + (j > m))
        best[j] = cost
    return best[n]


USUAL = Guesser(RANK)


def guess_bits(value: str) -> float:
    """The cost with the usual passwords as the only dictionary."""
    return USUAL.bits(value)


def dictionary(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> dict[str, float]:
    """{word: bits} of the usual passwords and the corpus: the ``max_words`` most
    frequent runs of 3 to 20 ASCII letters that occur ``min_count`` times or
    more, in lower case; the word of rank r costs log2(r + 1) bits.

    Counts cover all documents and combine in the tasks; only the bounded list
    of the first words is collected."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def table() -> pd.DataFrame:
            return pd.DataFrame({"w": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})
        for b in batches:
            for text in b["text"]:
                total.update(LETTERS.findall(text.lower()))
            if len(total) > 400_000:
                yield table()
                total.clear()
        yield table()

    n = F.length("w")
    counts = (documents(docs).select("text").mapInPandas(run, "w string, n long").where((n >= SHORTEST) & (n <= LONGEST))
              .groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    top = counts.orderBy(F.desc("n"), "w").limit(max_words).collect()
    out = {r["w"]: math.log2(k + 2) for k, r in enumerate(top)}
    return out | {w: min(b, out.get(w, b)) for w, b in RANK.items()}


def may_have_context(text: str) -> bool:
    """False only if neither ASSIGN nor CONTEXT can match: no credential word."""
    low = text.lower()
    return any(w in low for w in CREDENTIAL)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    if may_have_context(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if HEX_RUN in text.encode("latin-1", "replace").translate(HEX_MARK):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def guessed_spans(text: str, min_bits: float, taken: list[tuple[str, int, int]],
                  bits: Callable[[str], float] = guess_bits) -> list[tuple[str, int, int]]:
    """Values in credential contexts that cost ``min_bits`` or more and that no
    span of ``taken`` covers."""
    out, assigned = [], [(s, e) for k, s, e in taken]
    for m in CONTEXT.finditer(text) if may_have_context(text) else ():
        s, v = m.start(1), m[1].rstrip(TRAILING)
        e = s + len(v)
        if len(v) >= 6 and not any(a <= s and e <= b for a, b in assigned) and bits(v) >= min_bits:
            out.append(("guess", s, e))
    return out


def _order(x: tuple[str, int, int]) -> tuple[int, int]:
    return x[1], KINDS.index(x[0])


def scan(text: str, min_bits: float = MIN_BITS, bits: Callable[[str], float] = guess_bits) -> tuple[list, list]:
    """(base spans, all spans) of one text, in order."""
    base = base_spans(text)
    return base, sorted(base + guessed_spans(text, min_bits, base, bits), key=_order)


def secret_spans(docs: DataFrame, min_bits: float = MIN_BITS, words: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, bits>>) for every row;
    bits is the guess cost of a ``guess`` span and null for the others.
    ``words`` is the dictionary (default: learnt from ``docs``)."""
    words = dictionary(docs) if words is None else words

    def make():
        bits = Guesser(words).bits

        def one(text: str) -> tuple:
            return ([{"kind": k, "start": s, "end": e, "bits": bits(text[s:e]) if k == "guess" else None}
                     for k, s, e in scan(text, min_bits, bits)[1]],)
        return one

    return per_text(documents(docs), None, "spans array<struct<kind:string,start:int,end:int,bits:double>>", make)


def secret_digest(docs: DataFrame, min_bits: float = MIN_BITS, words: dict[str, float] | None = None) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans joined."""
    words = dictionary(docs) if words is None else words

    def join(spans) -> str:
        return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def make():
        bits = Guesser(words).bits

        def one(text: str) -> tuple:
            base, every = scan(text, min_bits, bits)
            n = [sum(k == x for k, _, _ in base) for x in KINDS[:3]]
            return (*n, hashlib.sha256(join(base).encode()).hexdigest(), join(every))
        return one

    return per_text(documents(docs), None,
                    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)
