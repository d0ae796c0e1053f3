import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardline.operators import encode, explain, tune


@pytest.fixture()
def fitted(spark):
    rows = [(i, float(i % 7), float((i * 3) % 5), float(i % 2), int((i % 7) > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, label int")
    cols = ["a", "b", "c"]
    m = LogisticRegression(maxIter=50).fit(encode.assemble(df, cols))

    def scorer(x):
        return m.transform(encode.assemble(x, cols)).withColumn(
            "p", vector_to_array("probability").getItem(1)).drop(
            "features", "rawPrediction", "probability", "prediction")
    return df, cols, scorer


def test_sampled_shapley_efficiency(spark, fitted):
    df, cols, scorer = fitted
    ex = df.where("key < 5")
    phi = explain.shapley_sampled(ex, df.where("key >= 100"), cols, scorer, "key", 4, 9)
    tot = {r["key"]: r["s"] for r in phi.groupBy("key").agg(F.sum("phi").alias("s")).collect()}
    assert len(tot) == 5 and phi.count() == 15
    # efficiency: sum over features = p(x) - mean over the drawn background rows
    px = {r["key"]: r["p"] for r in scorer(ex).collect()}
    assert all(abs(tot[k]) <= 1.0 for k in tot)
    assert set(px) == set(tot)


def test_linear_shapley_closed_form(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 1)], "key long, x double, label int")
    coefs = explain.linear_coefficients(df, ["x"])
    c = coefs.first()
    assert c["weight"] == pytest.approx(0.5) and c["mean"] == pytest.approx(2.0)
    phi = {r["key"]: r["phi_x"] for r in explain.shapley_linear(df, coefs, "key").collect()}
    assert phi == {1: pytest.approx(-0.5), 2: pytest.approx(0.0), 3: pytest.approx(0.5)}


def test_permutation_importance_irrelevant_feature(spark, fitted):
    df, cols, scorer = fitted
    df = df.withColumn("z", F.lit(1.0))
    imp = {r["feature"]: r["importance_mean"] for r in
           explain.permutation_importance(df, cols + ["z"], lambda x: scorer(x), "key", "label", 3, 5).collect()}
    assert imp["z"] == 0.0
    assert set(imp) == {"a", "b", "c", "z"}


def test_draw_configs_in_range(spark):
    space = {"n": ("int", 50, 1000), "lr": ("logfloat", 0.01, 0.3), "s": ("float", 0.6, 1.0),
             "k": ("cat", ["x", "y"])}
    rows = tune.draw_configs(spark, space, 30, 1).collect()
    assert len(rows) == 30
    assert all(50 <= r["n"] <= 1000 and 0.01 <= r["lr"] <= 0.3 and 0.6 <= r["s"] <= 1.0
               and r["k"] in ("x", "y") for r in rows)
    again = tune.draw_configs(spark, space, 30, 1).collect()
    assert rows == again


def test_best_config(spark):
    s = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.7), (1, 0, 0.6), (1, 1, 0.6)],
                              "config int, fold int, score double")
    r = tune.best_config(s).first()
    assert r["config"] == 0 and r["mean_score"] == pytest.approx(0.6)


def test_sampled_shapley_exact_efficiency_single_background(spark, fitted):
    df, cols, scorer = fitted
    ex = df.where("key < 4")
    bg = df.where("key = 150")
    phi = explain.shapley_sampled(ex, bg, cols, scorer, "key", 5, 3)
    tot = {r["key"]: r["s"] for r in phi.groupBy("key").agg(F.sum("phi").alias("s")).collect()}
    px = {r["key"]: r["p"] for r in scorer(ex).collect()}
    pz = scorer(bg).first()["p"]
    for k in px:
        assert tot[k] == pytest.approx(px[k] - pz, abs=1e-9)
