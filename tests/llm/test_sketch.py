"""Sketches of near-duplicate detection."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import near_dup, shingles


def some(r, n):
    return np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))


def test_signature_is_the_same_with_swaps_or_whole_permutations(monkeypatch):
    r = np.random.default_rng(1)
    sets = [some(r, n) for n in (0, 1, 2, 5, 20, 128, 300, 3000)] + [some(r, 90) for _ in range(40)]
    want = shingles.superminhash(sets, 64)
    for dense in (0, 5_000, 1 << 30):
        monkeypatch.setattr(shingles, "DENSE", dense)
        assert (shingles.superminhash(sets, 64) == want).all()


@pytest.mark.parametrize("percent", [80, 85])
def test_odd_sketch_lets_every_link_pass_and_little_else(spark, percent):
    r = np.random.default_rng(percent)
    rows, truth = [], []
    for i in range(400):
        a = some(r, int(r.choice([3, 9, 40, 70, 130, 260, 1000])))
        gone = int(len(a) * r.uniform(0, 0.5))
        b = np.unique(np.concatenate([a[gone:], some(r, int(gone * r.uniform(0, 1)))]))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        truth.append((common, union))
        rows.append((i, len(a), len(b), shingles.odd_sketch(a).tolist(), shingles.odd_sketch(b).tolist()))
    df = spark.createDataFrame(rows, "i long, na long, nb long, a array<long>, b array<long>")
    got = {x["i"]: x["ok"] for x in df.select("i", near_dup.plausible(F.col("na"), F.col("nb"), F.col("a"), F.col("b"), percent).alias("ok")).collect()}
    linked = [i for i, (c, u) in enumerate(truth) if 100 * c >= percent * u]
    assert len(linked) > 50 and all(got[i] for i in linked)
    far = [i for i, (c, u) in enumerate(truth) if u > 60 and 100 * c < (percent - 6) * u]
    assert len(far) > 50 and not any(got[i] for i in far)


def test_sketch_of_half_the_length_is_the_folded_one():
    r = random.Random(2)
    a = np.array(sorted({r.getrandbits(64) for _ in range(100)}), np.uint64)
    long = shingles.odd_sketch(a)
    at = shingles.mix(a ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(255)
    short = np.zeros(4, np.uint64)
    np.bitwise_xor.at(short, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    assert len(long) == 8 and (long[:4] ^ long[4:] == short.view(np.int64)).all()
