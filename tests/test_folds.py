"""Fold encoders, table vocabularies and multiplicities against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from wardline.operators import encode, folds, models, sample, vocab

K = 3


@pytest.fixture()
def rows():
    r = random.Random(7)
    return [(i, int(r.random() < 0.3), i % K, r.choice(["a", "b", "c", None] if i % 2 else ["a", "d"]),
             None if i % 11 == 0 else r.randint(1, 15), None if i % 13 == 0 else round(r.gauss(1e6, 2.0), 3),
             r.choice(["x", "y", None])) for i in range(120)]


@pytest.fixture()
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, fold int, cat string, ent long, num double, small string").repartition(4)


def pstats(values):
    m = sum(values) / len(values)
    return m, math.sqrt(sum((v - m) ** 2 for v in values) / len(values))


def test_scalers_are_those_of_the_other_folds(frame, rows):
    got = {r["fold"]: r for r in folds.fold_scalers(frame, ["num"]).collect()}
    for f in range(K):
        want = pstats([r[5] for r in rows if r[2] != f and r[5] is not None])
        assert (got[f]["mean"], got[f]["sd"]) == (pytest.approx(want[0], rel=1e-12), pytest.approx(want[1], rel=1e-9))


def test_vocabulary_and_shares_of_every_training_fold(frame, rows):
    levels = folds.fold_levels(frame, ["cat", "ent"])
    voc = folds.fold_vocabulary(levels, K)
    for f in range(K):
        train = [r for r in rows if r[2] != f]
        for c, at in (("cat", 3), ("ent", 4)):
            known = sorted({str(r[at]) for r in train if r[at] is not None})
            got = voc.where((F.col("fold") == f) & (F.col("column") == c)).orderBy("idx").collect()
            assert [(r["idx"], r["level"]) for r in got] == list(enumerate(known))
    total = folds.fold_totals(levels)
    wide = folds.with_fold_counts(frame, "ent", levels, "seen")
    got = {r["id"]: r for r in wide.select("id", *[folds.share("seen", total["ent"], f).alias(f"s{f}") for f in range(K)]).collect()}
    for f in range(K):
        n = Counter(r[4] for r in rows if r[2] != f and r[4] is not None)
        for r in rows:
            want = n[r[4]] / sum(n.values()) if n[r[4]] else None
            assert got[r[0]][f"s{f}"] == (None if want is None else pytest.approx(want))


def test_frame_of_a_fold_has_seen_no_held_out_row(spark, frame, rows):
    enc = folds.fit_fold_encoders(frame, "id", "label", ["cat", "rare"], ["num", "freq"], {"freq": "ent"}, {"rare": ("cat", 0.25)})
    for f in range(K):
        train = [r for r in rows if r[2] != f]
        mean, sd = pstats([r[5] for r in train if r[5] is not None])
        n, c = Counter(r[4] for r in train if r[4] is not None), Counter(r[3] for r in train if r[3] is not None)
        freq = {r[0]: n[r[4]] / sum(n.values()) if r[4] is not None else 0.0 for r in rows}
        fm, fs = pstats([freq[r[0]] for r in train])
        kept = {x for x in c if c[x] / sum(c.values()) >= 0.25}
        cats, rares = sorted(c)[1:], sorted(kept | {"Other"})[1:]
        for r in enc.frame(f).collect():
            row = rows[r["id"]]
            num = 0.0 if row[5] is None else (row[5] - mean) / sd
            want = [num, (freq[row[0]] - fm) / fs] + [float(row[3] == x) for x in cats]
            want += [float((row[3] if row[3] in kept else "Other") == x) for x in rares]
            assert list(r["features"].toArray()) == pytest.approx(want, abs=1e-7) and r["fold"] == row[2]


def test_column_of_50000_levels_encodes(spark):
    df = spark.range(60_000).selectExpr("id", "concat('k', id % 50000) AS wide", "CAST(id % 3 AS STRING) AS few", "CAST(id AS DOUBLE) AS num")
    enc = vocab.fit_encoder(df, ["wide", "few"], ["num"])
    assert enc.size == 1 + 49_999 + 2
    first = sorted(f"k{i}" for i in range(50_000))
    place = {x: i for i, x in enumerate(first)}
    v = {r["id"]: r["features"] for r in enc.vectors(df, ["id"]).where("id < 30").collect()}
    for i, x in v.items():
        want = {} if i == 0 else {0: float(i)}
        want |= {place[f"k{i}"]: 1.0} if place[f"k{i}"] else {}
        want |= {1 + 49_999 + i % 3 - 1: 1.0} if i % 3 else {}
        assert dict(zip(x.indices.tolist(), x.values.tolist())) == want
    assert len({r["name"] for r in enc.names(spark).collect()}) == enc.size
    m = LogisticRegression(maxIter=2).fit(enc.vectors(df.withColumn("label", (F.col("id") % 2).cast("int")), ["label"]))
    assert m.numFeatures == enc.size


def test_rare_levels_share_a_place(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("aaabbbczd")], "id long, c string")
    enc = vocab.fit_encoder(df, ["c"], [], drop_first=False, min_count=2)
    assert [r["name"] for r in enc.names(spark).orderBy("idx").collect()] == ["c_Other", "c_a", "c_b"]
    new = spark.createDataFrame([(1, "z"), (2, "b"), (3, "unseen"), (4, None)], "id long, c string")
    got = {r["id"]: [x["idx"] for x in r["entries"]] for r in enc.entries(new).collect()}
    assert got == {1: [0], 2: [2], 3: [], 4: []}


def test_missing_number_is_nan_and_zero_has_no_entry(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 2.5)], "id long, x double")
    v = {r["id"]: list(r["features"].toArray()) for r in vocab.fit_encoder(df, [], ["x"]).vectors(df, ["id"]).collect()}
    assert math.isnan(v[1][0]) and v[2] == [0.0] and v[3] == [2.5]


@pytest.mark.parametrize("keep", [False, True])
def test_multiplicities_are_the_drawn_copies(frame, rows, keep):
    counted = {r["id"]: r["times"] for r in sample.oversample_counts(frame, "label", "id", 5, keep).collect()}
    copies = Counter(r["id"] for r in sample.oversample(frame, "label", "id", 5, keep).collect())
    assert {i: t for i, t in counted.items() if t} == dict(copies) and len(counted) == len(rows)
    n1 = sum(r[1] for r in rows)
    assert sum(t for i, t in counted.items() if rows[i][1]) == len(rows) - n1
    if keep:
        assert all(t >= 1 for t in counted.values())


def test_weighted_fit_is_the_fit_on_copies(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, int(i % 5 == 0), float(i % 5 == 0) + r.gauss(0, 1), r.random()) for i in range(200)],
                               "key long, label int, x double, y double")
    df = encode.assemble(df, ["x", "y"])
    lr = LogisticRegression(maxIter=200, regParam=0.01, tol=1e-10, standardization=False)
    a = models.fit_balanced(df, lr, "resample")
    b = lr.fit(sample.oversample(df, "label", "key", 42, keep_original=True))
    assert list(a.coefficients) == pytest.approx(list(b.coefficients), abs=1e-5)
    net = models.fit_balanced(df, MultilayerPerceptronClassifier(layers=[2, 3, 2], maxIter=5, seed=1), "resample")
    assert net.numFeatures == 2
    with pytest.raises(ValueError):
        models.fit_balanced(df, MultilayerPerceptronClassifier(layers=[2, 3, 2]), "weights")
