import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import metrics


def _brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@pytest.fixture()
def scores(spark):
    rnd = random.Random(3)
    rows = [(i, int(rnd.random() < 0.3), round(rnd.random(), 2)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "key long, label int, p double")


def test_auc_matches_brute_force(scores):
    rows, df = scores
    got = metrics.roc_auc(df, partitions=7).first()["auc"]
    assert got == pytest.approx(_brute_auc([(y, p) for _, y, p in rows]))


def test_auc_negation_and_ties(spark, scores):
    rows, df = scores
    a = metrics.roc_auc(df).first()["auc"]
    b = metrics.roc_auc(df.withColumn("p", -F.col("p"))).first()["auc"]
    assert a + b == pytest.approx(1.0)
    tied = spark.createDataFrame([(0, 0.3), (1, 0.3), (1, 0.3)], "label int, p double")
    assert metrics.roc_auc(tied).first()["auc"] == 0.5


def test_auc_by_group(scores):
    rows, df = scores
    g = df.withColumn("g", (F.col("key") % 3).cast("int"))
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(g, group=["g"], partitions=5).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(_brute_auc([(y, p) for i, y, p in rows if i % 3 == k]))


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, p double")
    r = metrics.evaluate(df).first()
    assert (r["precision"], r["f1"], r["tp"]) == (0.0, 0.0, 0)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 0.5)], "label int, p double")
    assert metrics.predict_at(df).first()["pred"] == 0


def test_confusion_zero_filled(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, pred int")
    got = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion(df).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_threshold_sweep_brute_force(scores):
    rows, df = scores
    ts = [0.1, 0.25, 0.5, 0.53, 0.9]
    got = {r["threshold"]: r for r in metrics.threshold_sweep(df, ts).collect()}
    for t in ts:
        tp = sum(1 for _, y, p in rows if y == 1 and p > t)
        fp = sum(1 for _, y, p in rows if y == 0 and p > t)
        assert (got[t]["tp"], got[t]["fp"]) == (tp, fp)
        assert got[t]["tn"] + got[t]["fp"] == sum(1 for _, y, _ in rows if y == 0)


def test_log_loss(spark):
    import math
    df = spark.createDataFrame([(1, 0.8), (0, 0.4), (1, 1.0)], "label int, p double")
    want = -(math.log(0.8) + math.log(0.6) + math.log(1 - 1e-15)) / 3
    assert metrics.log_loss(df).first()["log_loss"] == pytest.approx(want)


def test_soft_vote_and_cascade(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.2)], "key long, label int, p double")
    b = spark.createDataFrame([(1, 1, 0.1), (2, 0, 0.6)], "key long, label int, p double")
    v = {r["key"]: r["p"] for r in metrics.soft_vote(a, b).collect()}
    assert v[1] == pytest.approx(0.66) and v[2] == pytest.approx(0.32)
    c = {r["key"]: r["pred"] for r in metrics.cascade(a, b, 0.5, 0.05).collect()}
    assert c == {1: 1, 2: 0}
