import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from wardline.sources.sinks import load_model, report_frame, save_model, write_report, write_top_csv
from wardline.sources.tables import read_csv


def test_read_csv_declared_schema(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "enc.csv")
    with open(p, "w") as f:
        f.write("encounter_id,diag_1,admission_type_id\n1,250.83,3\n2,V27,\n")
    df = read_csv(spark, p, "encounter_id long, diag_1 string, admission_type_id int")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "int"]
    assert [tuple(r) for r in df.orderBy("encounter_id").collect()] == [(1, "250.83", 3), (2, "V27", None)]


def test_write_top_csv(spark, tmpdir_path):
    df = spark.createDataFrame([(f"f{i}", float(i % 7)) for i in range(100)],
                               "feature string, importance double")
    out = os.path.join(tmpdir_path, "top")
    write_top_csv(df, out, 60)
    back = spark.read.option("header", True).schema("feature string, importance double").csv(out)
    rows = back.collect()
    assert len(rows) == 60
    vals = [(-r["importance"], r["feature"]) for r in rows]
    assert sorted(vals) == sorted((-float(i % 7), f"f{i}") for i in range(100))[:60]


def test_write_report_and_model_roundtrip(spark, tmpdir_path):
    rep = os.path.join(tmpdir_path, "report")
    write_report(report_frame(spark, {"accuracy": 0.5, "f1": 0.25}), rep)
    lines = sorted(r[0] for r in spark.read.text(rep).collect())
    assert lines == ["accuracy: 0.5", "f1: 0.25"]
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, label int")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LogisticRegression(maxIter=5)]).fit(df)
    path = os.path.join(tmpdir_path, "model")
    save_model(model, path)
    loaded = load_model(path)
    assert loaded.transform(df).count() == 20
    assert load_model(os.path.join(tmpdir_path, "missing"), fallback=model) is model
    with pytest.raises(Exception):
        load_model(os.path.join(tmpdir_path, "missing"))
