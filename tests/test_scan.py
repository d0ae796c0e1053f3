"""The two-level scan and what stands on it, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import metrics, order, report


def before(rows):
    """(group, order, value) -> sum of the values before, per (group, order)."""
    out, seen = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        out[g, o] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + (v or 0)
    return out


@pytest.mark.parametrize("partitions", [1, 7, 23, None])
def test_scan_over_groups_of_all_sizes(spark, partitions):
    r = random.Random(2)
    rows = [("hot", i, r.randint(0, 9)) for i in range(400)] + [(None, i, 1) for i in range(90)]
    rows += [(f"g{i % 60}", i, r.choice([None, 2])) for i in range(150)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = order.scan_before(df, ["g"], ["o"], {"x": F.col("v"), "n": F.lit(1)}, partitions)
    assert got.columns == ["g", "o", "v", "x", "n"]
    want, count = before(rows), before([(g, o, 1) for g, o, _ in rows])
    assert {(a["g"], a["o"]): (a["x"], a["n"]) for a in got.collect()} == {k: (want[k], count[k]) for k in want}


def test_scan_without_groups_and_by_two_columns(spark):
    rows = [(i % 3, f"k{i:03d}") for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(4)
    got = order.rank_in_order(df, [], ["a", "b"], "rank", partitions=9)
    assert [(r["a"], r["b"]) for r in got.orderBy("rank").collect()] == sorted(rows)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 101))


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "g string, o long, v long")
    assert order.scan_before(df, ["g"], ["o"], {"x": F.col("v")}).collect() == []
    assert order.scan_before(df, [], ["o"], {"x": F.col("v")}).collect() == []


def test_scan_spreads_one_hot_group(spark):
    df = spark.range(20_000).selectExpr("1 AS g", "id AS o")
    got = order.scan_before(df, ["g"], ["o"], {"n": F.lit(1)}, 16)
    per = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per) < 6_000
    assert got.where("n <> o").count() == 0


def test_history_without_a_hot_entity_and_without_an_entity(spark):
    rows = [(i, None if i % 10 == 0 else i // 3, i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ent long, v long")
    got = {r["id"]: (r["prior_n"], r["v_prior"]) for r in report.entity_prior(df, "ent", "id", "id", ["v"]).collect()}
    for i, e, _ in rows:
        earlier = [v for j, x, v in rows if x == e and j < i]
        assert got[i] == (len(earlier), sum(earlier))


def test_metrics_of_no_rows_and_of_no_scores(spark):
    none = spark.createDataFrame([], "label int, p double")
    unscored = spark.createDataFrame([(1, None), (0, None)], "label int, p double")
    for df, n in ((none, 0), (unscored, 2)):
        r = metrics.evaluate(df).first()
        assert (r["n"], r["tp"], r["fp"], r["precision"], r["f1"], r["auc"]) == (n, 0, 0, 0.0, 0.0, None)
        assert metrics.roc_auc(df).first()["auc"] is None
        assert metrics.pr_curve(df).collect() == []
    g = unscored.withColumn("g", F.lit("a"))
    assert [(r["g"], r["n"], r["auc"]) for r in metrics.evaluate(g, group=["g"]).collect()] == [("a", 2, None)]
    assert metrics.evaluate(g.limit(0), group=["g"]).collect() == []


@pytest.mark.parametrize("group", [[], ["g"]])
def test_curve_has_every_distinct_score(spark, group):
    r = random.Random(5)
    rows = [(r.choice(["a", None]) if group else "a", int(r.random() < 0.4), round(r.random(), 1)) for _ in range(200)] + [("a", 0, None)]
    df = spark.createDataFrame(rows, "g string, label int, p double").repartition(3)
    curve = metrics.pr_curve(df, group=group, beta=2.0, partitions=5)
    got = {(c["g"] if group else "a", c["threshold"]): c for c in curve.collect()}
    assert len(got) == len({(g, p) for g, _, p in rows if p is not None})
    for (g, t), c in got.items():
        of = [(y, p) for x, y, p in rows if x == g and p is not None]
        tp, fp = sum(y and p >= t for y, p in of), sum(not y and p >= t for y, p in of)
        fn, tn = sum(y for y, _ in of) - tp, sum(not y for y, _ in of) - fp
        assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (tp, fp, fn, tn)
        assert c["fbeta"] == pytest.approx(5 * tp / (5 * tp + 4 * fn + fp)) and c["recall"] == pytest.approx(tp / (tp + fn))
    for b in metrics.best_threshold(curve, group).collect():
        mine = [c for (g, _), c in got.items() if g == (b["g"] if group else "a")]
        top = max(mine, key=lambda c: (c["fbeta"], c["threshold"]))
        assert (b["threshold"], b["fbeta"]) == (top["threshold"], top["fbeta"])
        steps = sorted(mine, key=lambda c: -c["threshold"])
        area = sum((c["recall"] - (steps[i - 1]["recall"] if i else 0.0)) * c["precision"] for i, c in enumerate(steps))
        assert b["average_precision"] == pytest.approx(area)
