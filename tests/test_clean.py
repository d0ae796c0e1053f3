import pytest
from pyspark.sql import functions as F

from wardline.operators import clean


def test_exclude_codes_keeps_null(spark):
    df = spark.createDataFrame([(1,), (11,), (19,), (20,), (21,), (None,)], "d int")
    got = [r[0] for r in clean.exclude_codes(df, "d", [11, 19, 20, 21]).collect()]
    assert got == [1, None]


def test_exclude_value_keeps_null(spark):
    df = spark.createDataFrame([("Female",), ("Unknown/Invalid",), (None,)], "g string")
    got = [r[0] for r in clean.exclude_value(df, "g", "Unknown/Invalid").collect()]
    assert got == ["Female", None]


def test_binary_target_missing_is_zero(spark):
    df = spark.createDataFrame([("<30",), (">30",), ("NO",), (None,)], "readmitted string")
    got = [r[0] for r in clean.binary_target(df, "readmitted", "<30").collect()]
    assert got == [1, 0, 0, 0]


def test_replace_sentinel_all_string_columns(spark):
    df = spark.createDataFrame([("?", "a", 1), ("x", "?", 2)], "a string, b string, n int")
    got = [tuple(r) for r in clean.replace_sentinel(df).collect()]
    assert got == [("Unknown", "a", 1), ("x", "Unknown", 2)]


def test_drop_constant_counts_null(spark):
    df = spark.createDataFrame([(1, "No", None, "x"), (1, "No", None, None)],
                               "a int, b string, c string, d string")
    assert clean.drop_constant(df).columns == ["d"]


def test_sanitize_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a[b` int, `a]b` int")
    with pytest.raises(ValueError):
        clean.sanitize_columns(df)


def test_align_to(spark):
    df = spark.createDataFrame([(1, 5, 9)], "a int, b int, extra int")
    out = clean.align_to(df, ["b", "a", "missing"])
    assert out.columns == ["b", "a", "missing"]
    assert tuple(out.first()) == (5, 1, 0)


def test_shape_report(spark):
    df = spark.range(7).withColumn("x", F.lit(1))
    r = clean.shape_report(df, "t").first()
    assert (r["n_rows"], r["n_cols"]) == (7, 2)


def test_columns_by_type_and_suffix(spark):
    df = spark.createDataFrame([(1, 2, "a", 1.5, "x")],
                               "id long, n int, s string, d double, diag_1_cat string")
    assert clean.columns_by_type(df, "string") == ["s", "diag_1_cat"]
    assert clean.columns_by_type(df, "integer") == ["id", "n"]
    assert clean.columns_by_type(df, "numeric") == ["id", "n", "d"]
    assert clean.split_by_suffix(df, "_cat") == (["diag_1_cat"], ["id", "n", "s", "d"])
    cat = clean.as_category(df, ["id"])
    assert cat.schema["id"].dataType.simpleString() == "string"
    assert [r["type"] for r in clean.schema_table(df).orderBy("position").collect()] == \
        ["bigint", "int", "string", "double", "string"]
