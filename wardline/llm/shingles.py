"""Word shingles and SuperMinHash signatures, vectorised over many texts.

Words are maximal runs of anything but ASCII white space, with A-Z lower-cased.
Hashes depend on the bytes alone, so all executors agree on them.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
#: Entries of the permutations that are held whole, two bytes each.
DENSE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, U(p), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text number of each word) of several texts."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_LOWER[b].astype(np.uint64) + U(1)) * _powers(_P, len(b)), out=total[1:])
    h = (total[last] - total[first]) * _powers(_INV, len(b))[first]
    h = mix(h ^ mix((last - first).astype(np.uint64)))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(ends, first, side="right")


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  A text with fewer words
    than ``width`` has its whole sequence as one; one without words, none."""
    h, of = word_hashes(texts)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    mult = [U((0xD6E8FEB86659FD93 * (2 * k + 1)) & (2 ** 64 - 1)) for k in range(width)]
    g = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        g += mix(h[k:len(h) - width + 1 + k] + U(k + 1)) * mult[k]
    g = mix(g)
    for i in range(len(texts)):
        lo, hi = bounds[i], bounds[i + 1]
        if hi - lo >= width:
            out.append(np.unique(g[lo:hi - width + 1]))
        elif hi > lo:
            s = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                s = mix(s * mult[k - lo] + h[k:k + 1])
            out.append(s)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], m: int = 128) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` slots per set.

    Every element draws a random permutation of the slots step by step
    (Fisher-Yates); at step j it offers j plus a random fraction to the slot it
    draws.  A slot keeps the least offer, so as soon as all slots of a set hold
    offers of steps up to j, later steps can't matter and the set is done.
    The steps run for all unfinished sets at once.  A permutation is its swaps
    until few elements are left.  Empty sets keep the greatest value in all slots."""
    full = U(2 ** 64 - 1)
    sig = np.full((len(sets), m), full, np.uint64)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return sig
    elems = np.concatenate([sets[i] for i in live])
    owner = np.repeat(live, [len(sets[i]) for i in live])
    drawn: list[np.ndarray] = []  # places drawn so far, while whole permutations would take too much memory
    perm = None
    for j in range(m):
        if perm is None and len(elems) * m <= DENSE:
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elems), 1))
            rows = np.arange(len(elems))
            for i, k in enumerate(drawn):
                perm[rows, k], perm[rows, i] = perm[rows, i], perm[rows, k].copy()
            drawn = []
        u = mix(elems + U((j * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & (2 ** 64 - 1)))
        k = (j + (u >> U(32)) % U(m - j)).astype(np.int64)
        offer = (U(j) << U(56)) | (mix(u) >> U(8))
        if perm is None:
            slot = k
            for i in range(j - 1, -1, -1):  # what lies at place k after j swaps
                slot = np.where(slot == i, drawn[i], np.where(slot == drawn[i], i, slot))
            drawn.append(k.astype(np.uint16))
        else:
            rows = np.arange(len(elems))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        np.minimum.at(sig.reshape(-1), owner * m + slot, offer)
        unfilled = (sig >= (U(j + 1) << U(56))).any(axis=1)
        keep = unfilled[owner]
        if not keep.any():
            break
        if not keep.all():
            elems, owner = elems[keep], owner[keep]
            if perm is None:
                drawn = [x[keep] for x in drawn]
            else:
                perm = perm[keep]
    return sig


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's elements over 64 * 2^k bits, 4 to 8 for each element.

    Each element flips one bit, so two sketches differ in no more bits than the
    sets differ in elements: a bound that never errs.  Folding the halves of a
    sketch together gives the sketch of half its length."""
    bits = 64
    while bits < 4 * len(s):
        bits *= 2
    at = mix(s ^ U(0x2545F4914F6CDD1D)) & U(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_xor.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out.view(np.int64)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` slots, as int64; left-over slots are unused."""
    n = sig.shape[1] // rows
    out = np.zeros((len(sig), n), np.uint64)
    for k in range(rows):
        out = mix(out * U(0xD6E8FEB86659FD93) + sig[:, k:n * rows:rows])
    return out.view(np.int64)


def chunks(texts: list[bytes], size: int = 1 << 20):
    """Ranges of texts of about ``size`` bytes together, so that work arrays
    stay small; a longer text is alone."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)
