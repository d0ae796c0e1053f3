"""Branches and votes; copies of permutation importance; weighted backgrounds."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardline.operators import encode, ensemble, explain, models


@pytest.fixture()
def frame(spark):
    r = random.Random(4)
    rows = [(i, int(r.random() < 0.3), r.choice(["a", "b", None]), r.choice("xyz"), float(i % 5), r.random()) for i in range(200)]
    return rows, spark.createDataFrame(rows, "id long, label int, u_cat string, v_cat string, n double, m double").repartition(3)


def test_vote_of_closed_forms(frame):
    rows, df = frame
    train, test = df.where("id < 150"), df.where("id >= 150")
    b = ensemble.fit_branches(train, {"codes": ["u_cat", "v_cat"], "rest": ["n", "m"]},
                              {"codes": ensemble.level_rates, "rest": ensemble.linear_rates})
    got = {r["id"]: r for r in ensemble.vote(test, b, {"codes": 0.7, "rest": 0.3}).collect()}
    assert set(got) == set(range(150, 200))
    tr = rows[:150]
    base = sum(r[1] for r in tr) / 150
    for i, r in got.items():
        row, rates = rows[i], []
        for at in (2, 3):
            ys = [x[1] for x in tr if x[at] == row[at] and row[at] is not None]
            rates.append(sum(ys) / len(ys) if ys else base)
        assert r["p_codes"] == pytest.approx(sum(rates) / 2)
        assert r["p"] == pytest.approx(0.7 * r["p_codes"] + 0.3 * r["p_rest"]) and 0 <= r["p_rest"] <= 1


def test_branches_need_their_own_columns(frame):
    _, df = frame
    for cols in ({"a": ["n"], "b": ["n"]}, {"a": [], "b": ["n"]}):
        with pytest.raises(ValueError):
            ensemble.fit_branches(df, cols, dict.fromkeys(cols, ensemble.linear_rates))


def test_vector_branch_keeps_rows_and_columns(frame):
    _, df = frame
    s = ensemble.vector_model(df, ["u_cat", "v_cat"], models.forest(3, 3), True, key="id", balance="resample")
    out = s(df, "p_x")
    assert out.columns == [*df.columns, "p_x"] and out.count() == 200
    assert out.where("p_x IS NULL OR p_x < 0 OR p_x > 1").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 36, 97])
def test_each_row_gives_its_value_once_in_each_copy(spark, n):
    df = spark.createDataFrame([(i, 10.0 * i, 100 * i) for i in range(n)], "id long, a double, b int").repartition(3)
    got = explain.permuted(df, ["a", "b"], "id", 4, 9)
    assert got.columns == ["_wl_f", "_wl_r", "id", "a", "b"] and dict(got.dtypes)["b"] == "int"
    by = {}
    for r in got.collect():
        by.setdefault((r["_wl_f"], r["_wl_r"]), []).append((r["id"], r["a"], r["b"]))
    assert len(by) == 8
    for (f, _), rows in by.items():
        assert sorted(x[0] for x in rows) == list(range(n))
        assert sorted(x[1] for x in rows) == [10.0 * i for i in range(n)] and sorted(x[2] for x in rows) == [100 * i for i in range(n)]
        kept = 2 if f == "a" else 1
        assert all(x[kept] == x[0] * (100 if kept == 2 else 10) for x in rows)
    if n == 97:
        assert len({tuple(sorted(v)) for v in by.values()}) == 8


def test_values_move_once_and_nothing_is_broadcast(spark):
    # the written table is small, its rows times features are not
    df = spark.range(400).selectExpr("id", "cast(id % 3 as double) a", "cast(id % 5 as double) b", "id % 2 as label")
    got = explain.permuted(df, ["a", "b"], "id", 3, 9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Join") == 1
    assert got.count() == 400 * 2 * 3


def test_donors_by_the_inverse_beyond_bigint_products():
    # n near 2^41: a * x passes 2^63 unless it is taken in two steps
    n = (1 << 41) - 21
    for f, r, a, b in explain.donor_keys(["a", "b"], 5, n, 7):
        inv = pow(a, -1, n)
        high, low = divmod(inv, explain.MULTIPLIERS)
        for y in (0, 1, n // 3, n - 1):
            x = (y - b) % n
            assert max(high * x, (high * x % n) * explain.MULTIPLIERS + low * x) < 1 << 63
            assert (a * ((high * x % n * explain.MULTIPLIERS + low * x) % n) + b) % n == y


@pytest.mark.parametrize("score", ["accuracy", "log_loss", "auc"])
def test_importance_by_each_score(spark, score):
    rows = [(i, i % 2, float(i % 2), float(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, x double, z double")

    def scorer(d):
        return d.withColumn("p", F.lit(0.1) + F.lit(0.8) * F.col("x"))
    got = {r["feature"]: r for r in explain.permutation_importance(df, ["x", "z"], scorer, "id", "label", 3, 5, score=score).collect()}
    assert got["z"]["importance_mean"] == pytest.approx(0, abs=1e-12)
    assert got["x"]["importance_mean"] > 0.3 and set(got) == {"x", "z"}
    with pytest.raises(ValueError):
        explain.permutation_importance(df, ["x"], scorer, "id", score="gini")


def test_background_rows_are_drawn_by_weight(spark):
    bg = spark.createDataFrame([(1, 0.0, 1), (2, 10.0, 97), (3, 20.0, 0), (4, 30.0, 2)], "id long, x double, size long")
    ranges, total, width = explain.draw_weighted(bg, "id", "size", 4)
    assert total == 100 and {r["id"] for r in ranges.collect()} == {1, 2, 4}
    ex = spark.createDataFrame([(100 + i, 5.0) for i in range(60)], "id long, x double")

    def scorer(d):
        return d.withColumn("p", F.col("x"))
    phi = explain.shapley_sampled(ex, bg, ["x"], scorer, "id", 20, 3, weight="size", keep_base=True)
    bases = [r["base"] for r in phi.collect()]
    assert len(bases) == 60 and abs(sum(bases) / 60 - (0.97 * 10 + 0.02 * 30)) < 0.5
    with pytest.raises(ValueError):
        explain.shapley_sampled(ex, bg.where("size = 0"), ["x"], scorer, "id", 2, 3, weight="size")


def test_values_of_a_forest_add_up_per_row(spark):
    r = random.Random(2)
    rows = [(i, int(r.random() < 0.4), r.random(), float(i % 4), r.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    cols = ["a", "b", "c"]
    vec = encode.assemble(df, cols)
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(vec)

    def scorer(d):
        return model.transform(encode.assemble(d, cols)).withColumn("p", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")
    summary = explain.kmeans_summary(vec, 20, "features", 1)
    assert summary.agg(F.sum("size")).first()[0] == 300
    bg = explain.centroid_background(summary, cols, "id")
    phi = explain.shapley_sampled(df.where("id < 12"), bg, cols, scorer, "id", 6, 9, weight="size", keep_base=True).collect()
    assert Counter(x["id"] for x in phi) == dict.fromkeys(range(12), 3)
    p = {x["id"]: x["p"] for x in scorer(df.where("id < 12")).collect()}
    for i in range(12):
        mine = [x for x in phi if x["id"] == i]
        assert math.isclose(sum(x["phi"] for x in mine), mine[0]["full"] - mine[0]["base"], abs_tol=1e-9)
        assert mine[0]["full"] == pytest.approx(p[i])


def test_training_rows_are_dealt_by_their_dense_size(spark, monkeypatch):
    rows = [(i if i % 10 else None, i % 2, float(i), float(i % 7)) for i in range(2000)]
    df = encode.assemble(spark.createDataFrame(rows, "key long, label int, a double, b double").coalesce(1), ["a", "b"])
    df = df.select("key", "label", "features")
    assert models.dealt(df, key="key") is df and models.dealt(df.where("label > 5")).count() == 0
    monkeypatch.setattr(models, "FEW_CELLS", 100)
    monkeypatch.setattr(models, "PART_CELLS", 100)
    cores = spark.sparkContext.defaultParallelism
    for key in ("key", None):
        out = models.dealt(df, key=key)
        sizes = out.rdd.glom().map(len).collect()
        assert len(sizes) % cores == 0 and len(sizes) >= 4000 // 100 and sum(sizes) == 2000
        assert max(sizes) <= 4 * 2000 / len(sizes) + 20
        assert out.exceptAll(df).count() == df.exceptAll(out).count() == 0
    # what fits are given
    seen = []

    class Fits:
        def hasParam(self, name):
            return True

        def getParam(self, name):
            return name

        def copy(self, extra):
            return self

        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())

    keyed = df.where("key is not null")
    for balance in ("none", "resample", "weights"):
        models.fit_balanced(keyed, Fits(), balance, "label", "key")
    assert min(seen) >= 3600 // 100 and len(seen) == 3
