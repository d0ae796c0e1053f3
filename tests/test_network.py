"""Networks fitted on weighted sparse rows are Spark's networks on their copies."""

import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from wardline import session
from wardline.operators import models, network, sample


def _rows(n, size, seed, dense=False):
    r, out = random.Random(seed), []
    for i in range(n):
        x = {0: r.gauss(0, 1), 1: r.gauss(0, 2), 2 + r.randrange(size - 2): 1.0}
        if r.random() < 0.5:
            x[2 + r.randrange(size - 2)] = r.choice([1.0, -2.0])
        v = Vectors.sparse(size, x)
        y = int(x[0] + 0.4 * len(x) + 0.3 * r.gauss(0, 1) > 1)
        out.append((i, y, Vectors.dense(v.toArray()) if dense and i % 3 else v, float(r.randrange(4))))
    return out


def test_the_fit_is_sparks_fit_on_the_copies(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK_ROWS", 64)
    rows = spark.createDataFrame(_rows(300, 60, 5, dense=True), ["key", "label", "features", "weight"]).coalesce(2)
    for layers, iters, df in (([60, 5, 4, 2], 12, rows), ([60, 2], 6, rows.drop("weight"))):
        est = MultilayerPerceptronClassifier(layers=layers, maxIter=iters, seed=7, blockSize=4096)
        mine = models.fit(est, df)
        # in one block Spark's loss is the mean over all rows
        want = est.fit((sample.expand(df, "weight") if "weight" in df.columns else df).coalesce(1))
        assert mine.weights.toArray() == pytest.approx(want.weights.toArray(), abs=1e-5)
        got, exp = (models.score(m, df, "key").orderBy("key").toPandas()["p"].to_numpy() for m in (mine, want))
        assert got == pytest.approx(exp, abs=1e-5)


def test_rows_are_not_copied(spark):
    # copies of a row would take 10^11 rows
    df = spark.createDataFrame(_rows(40, 12, 2), ["key", "label", "features", "weight"]).selectExpr(
        "key", "label", "features", "weight * 1e10 weight")
    model = models.fit(MultilayerPerceptronClassifier(layers=[12, 3, 2], maxIter=5, seed=1), df)
    same = models.fit(MultilayerPerceptronClassifier(layers=[12, 3, 2], maxIter=5, seed=1), df.selectExpr("key", "label", "features", "weight / 1e10 weight"))
    assert model.weights.toArray() == pytest.approx(same.weights.toArray(), abs=1e-9)


def test_steps_reach_the_minimum():
    a = np.diag(np.arange(1.0, 9.0))
    x = network.minimize(lambda v: (0.5 * v @ a @ v - v.sum(), a @ v - 1.0), np.zeros(8), 200, 1e-12)
    assert x == pytest.approx(1 / np.arange(1.0, 9.0), abs=1e-4)


def test_what_a_network_cannot_take(spark):
    est = MultilayerPerceptronClassifier(layers=[2, 2], maxIter=2, seed=1)
    v = Vectors.dense([1.0, 0.0])
    for label, x in ((2, v), (0, Vectors.dense([1.0])), (None, v)):
        with pytest.raises(PythonException):
            models.fit(est, spark.createDataFrame([(1, v), (label, x)], ["label", "features"]))
    with pytest.raises(ValueError):
        models.fit(est, spark.createDataFrame([(1, v)], ["label", "features"]).where("label = 0"))


def test_few_files_are_read_over_all_cores(spark, monkeypatch, tmpdir_path):
    spark.range(50).coalesce(1).write.parquet(tmpdir_path + "/one")
    one, cores = spark.read.parquet(tmpdir_path + "/one"), spark.sparkContext.defaultParallelism
    assert session.spread(one) is one
    monkeypatch.setattr(session, "FEW_ROWS", 50)
    out = session.spread(one)
    assert out.rdd.getNumPartitions() == cores and sorted(r["id"] for r in out.collect()) == list(range(50))
    many = spark.range(100).repartition(cores + 1)
    assert session.spread(many) is many


def test_a_network_is_fitted_to_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(models, "FEW_CELLS", 0)
    monkeypatch.setattr(models, "PART_CELLS", 1)    # Spark's trees would have one cell in each
    seen = []
    monkeypatch.setattr(network, "fit", lambda e, rows, w=None: seen.append(rows.rdd.getNumPartitions()))
    df = spark.createDataFrame(_rows(100, 12, 2), ["key", "label", "features", "weight"])
    with models.Training(df, key="key") as t:
        t.fit(MultilayerPerceptronClassifier(layers=[12, 3, 2]))
    assert seen[0] <= spark.sparkContext.defaultParallelism
