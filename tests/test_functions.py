from pyspark.sql import functions as F

from wardline.functions import dose_ordinal, icd_coarse, icd_fine, sanitize_name


def test_dose_ordinal(spark):
    df = spark.createDataFrame([("No",), (" steady ",), ("UP",), ("down",), ("?",), (None,)], "d string")
    got = [r[0] for r in df.select(dose_ordinal("d")).collect()]
    assert got == [0.0, 2.0, 3.0, 1.0, None, None]


def test_icd_coarse(spark):
    vals = ["250.83", "414", "V45", "785", "251", "?", None, "139"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r[0] for r in df.select(icd_coarse("c")).collect()]
    assert got == ["Diabetes", "Circulatory", "Other", "Circulatory", "Diabetes", "Other",
                   "Other", "Other"]


def test_icd_fine(spark):
    vals = ["250.83", "428", "786", "820", "715", "174", "788", "E909"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r[0] for r in df.select(icd_fine("c")).collect()]
    assert got == ["icd_250", "icd_428", "icd_786", "Injury", "Musculoskeletal", "Neoplasms",
                   "Genitourinary", "Other"]


def test_icd_edge_roots(spark):
    df = spark.createDataFrame([(".5",), ("",), ("0250",), ("V27",)], "c string")
    got = [r[0] for r in df.select(icd_fine("c")).collect()]
    assert got == ["Other", "Other", "icd_250", "Other"]


def test_sanitize_name():
    assert [sanitize_name(x) for x in ["age_[50-60)", "a<b", "a>b", "x,y"]] == \
        ["age__50-60)", "a_lt_b", "a_gt_b", "x_y"]


def test_no_python_udf_in_plan(spark):
    df = spark.createDataFrame([("250.1", "Up")], "c string, d string")
    plan = df.select(icd_fine("c"), dose_ordinal("d"))._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert df.select(F.lit(1)).count() == 1
