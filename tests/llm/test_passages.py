"""Removal of repeated passages against a plain reading of its rule."""

import hashlib
import random

import numpy as np
import pytest

from wardline.llm import passages


def cut(rows, length=20):
    """Rows of one id count as one document; no id comes last."""
    def key(i):
        return (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            k, place = tuple(w[p:p + length]), (key(i), p)
            if place < first.get(k, ((True, 1 << 70), 0)):
                first[k] = place
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < (key(i), p):
                gone[p:p + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS print", "1 AS late", "2 AS seg", "3 AS a", "4 AS doc", "5 AS words")


def fixture(seed, docs=120, length=20):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["é", "ÀB", "x."]
    lines = [[r.choice(vocab) for _ in range(r.randint(length - 3, 3 * length))] for _ in range(9)]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice(vocab) for _ in range(r.randint(0, 15))]
            line = r.choice(lines)
            lo = r.randint(0, len(line) // 3)
            w += line[lo:r.randint(lo, len(line))]
        rows.append((i, r.choice([" ", "\n", "  ", "\t \r\n"]).join(w)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "again " * 300), (504, "a b " * 200), (505, rows[3][1] + " " + rows[3][1]),
             (7, rows[7][1]), (7, rows[9][1]), (None, rows[11][1] + " tail"), (None, rows[11][1]), ((1 << 63) - 1, rows[12][1]), (-4, rows[13][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_matches_brute_force(spark, seed):
    rows = fixture(seed)
    got = passages.remove_passages(frame(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = cut(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[2] for r in want) > 500


def test_small_pieces_shards_and_streams_give_the_same(spark, monkeypatch):
    rows = fixture(3, length=6)
    monkeypatch.setattr(passages, "PIECE", 7)
    monkeypatch.setattr(passages, "SHARD", 30)
    monkeypatch.setattr(passages, "STREAM", 50)
    got = passages.remove_passages(frame(spark, rows).repartition(3), length=6)
    assert sorted(map(tuple, got.collect()), key=str) == cut(rows, 6)


def test_many_copies_and_repeated_rows(spark):
    text = " ".join(f"t{k}" for k in range(90))
    rows = [(k, text) for k in range(300)] + [(5, text)] * 50 + [(1000, text + " new " + text)]
    got = passages.remove_passages(frame(spark, rows).repartition(6), keep_text=True)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["n_removed"], r["kept"]))
    assert by[0] == [(0, text)] and by[1000] == [(180, "new")] and by[5] == [(90, "")] * 51


def test_empty_tables_and_texts(spark):
    assert passages.remove_passages(frame(spark, [])).collect() == []
    got = passages.remove_passages(frame(spark, [(1, None), (2, "short"), (None, None)])).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (0, 0), (1, 0)]
    with pytest.raises(ValueError):
        passages.remove_passages(frame(spark, []), length=1)


def test_automaton_finds_the_earliest_place_of_each_window():
    r = random.Random(4)
    for _ in range(30):
        texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 30))] for _ in range(5)]
        auto, first, end = passages.Automaton(), {}, 0
        for t in texts:
            auto.add(t)
            for p in range(len(t) - 3):
                first.setdefault(tuple(t[p:p + 4]), end + p + 3)
            end += len(t)
        q = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        want = [(p + 3, first[tuple(q[p:p + 4])]) for p in range(57) if tuple(q[p:p + 4]) in first]
        assert list(auto.matches(q, 4)) == want


def test_word_hashes_depend_on_the_word_alone():
    h, of, first, last = passages.words_of([b"ab  cd", b"", b"cd Ab\x0bab "])
    assert list(of) == [0, 0, 2, 2, 2] and h[0] == h[4] and h[1] == h[2] and h[3] != h[0]
    assert list(zip(first, last)) == [(0, 2), (4, 6), (0, 2), (3, 5), (6, 8)]
    x = np.arange(1, 60, dtype=np.uint64)
    assert (passages.rolled(np.concatenate([x, x]), 20)[:40] == passages.rolled(np.concatenate([x, x]), 20)[59:99]).all()
