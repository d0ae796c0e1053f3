import pytest
from pyspark.sql import functions as F

from wardline.operators import encode, vocab
from wardline.operators.joins import hot_key_join


def test_share_threshold_inclusive(spark):
    rows = [("a",)] * 99 + [("b",)] * 1           # b holds exactly 1 %
    df = spark.createDataFrame(rows * 1, "c string")
    out = encode.rare_bucket(df, "c", min_share=0.01, out="r")
    assert sorted(set(r[0] for r in out.select("r").collect())) == ["a", "b"]
    out2 = encode.rare_bucket(df, "c", min_share=0.02, out="r")
    assert sorted(set(r[0] for r in out2.select("r").collect())) == ["Other", "a"]


def test_rare_bucket_by_count(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)], "c string")
    out = encode.rare_bucket(df, "c", min_share=None, min_count=3, out="r")
    assert sorted(r[0] for r in out.select("r").collect()) == ["Other"] * 3 + ["a"] * 5


def test_frequency_encode_with_hot_key(spark):
    # one key holds a third of all rows
    rows = [(i, 0) for i in range(300)] + [(300 + i, 1 + i % 200) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k long")
    out = encode.frequency_encode(df, "k", "f")
    got = dict((r["id"], r["f"]) for r in out.collect())
    assert len(got) == 900
    assert got[0] == pytest.approx(300 / 900)
    assert got[300] == pytest.approx(3 / 900)


def test_hot_key_join_equals_plain_join(spark):
    big = spark.createDataFrame([(i, i % 3 if i % 2 else 0) for i in range(500)], "id long, k long")
    right = spark.createDataFrame([(0, "zero"), (1, "one")], "k long, v string")
    hot = spark.createDataFrame([(0,)], "k long")
    a = sorted(tuple(r) for r in hot_key_join(big, right, "k", hot, "left", 16).collect())
    b = sorted(tuple(r) for r in big.join(right, "k", "left").collect())
    assert a == b


def test_one_hot_drop_first_unknown_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "x string")
    levels = encode.vocabulary_levels(encode.fit_vocabulary(train, ["x"]))
    assert levels == {"x": ["a", "b", "c"]}
    test = spark.createDataFrame([(1, "a"), (2, "c"), (3, "zz"), (4, None)], "id int, x string")
    out = encode.one_hot(test, levels, drop_first=True)
    assert out.columns == ["id", "x_b", "x_c"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0, 0), (2, 0, 1), (3, 0, 0), (4, 0, 0)]


def test_sparse_one_hot_matches_explicit(spark):
    train = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, "c", 3.0)], "id int, x string, n double")
    test = spark.createDataFrame([(4, "a", 0.5), (5, "c", 1.5), (6, "zz", 2.5), (7, None, 3.5)],
                                 "id int, x string, n double")
    dense = {r["id"]: list(r["features"].toArray()) for r in vocab.fit_encoder(train, ["x"], ["n"]).vectors(test, ["id"]).collect()}
    levels = encode.vocabulary_levels(encode.fit_vocabulary(train, ["x"]))
    for r in encode.one_hot(test, levels, drop_first=True).collect():
        assert dense[r["id"]] == [r["n"], r["x_b"], r["x_c"]]


def test_inverse_one_hot(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 0, 1), (3, 0, 0, 0)],
                               "id int, `c_a` int, `c_b` int, `c_c` int")
    out = encode.inverse_one_hot(df, "c", ["a", "b", "c"], "b")
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "a"), (2, "c"), (3, "b")]


def test_inverse_of_keep_all_is_identity(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("abcabca")], "id int, x string")
    levels = encode.vocabulary_levels(encode.fit_vocabulary(df, ["x"]))
    wide = encode.one_hot(df, levels, drop_first=False)
    back = encode.inverse_one_hot(wide, "x", levels["x"], "a")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, k double")
    stats = {r["column"]: r for r in encode.fit_scaler(df, ["x", "k"]).collect()}
    assert stats["x"]["sd"] == pytest.approx(1.247219, abs=1e-6)
    out = encode.scale_population(df, ["x", "k"]).collect()
    assert [r["k"] for r in out] == [0.0, 0.0, 0.0]
    xs = [r["x"] for r in out]
    assert sum(xs) == pytest.approx(0.0, abs=1e-12)
    assert sum(v * v for v in xs) / 3 == pytest.approx(1.0)


def test_vocabulary_cap(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("x"))
    with pytest.raises(ValueError):
        encode.vocabulary_levels(encode.fit_vocabulary(df, ["x"]), max_levels=10)


def test_hot_key_rows_spread_over_tasks(spark):
    """A key holding a third of the rows lands in many join tasks, not one."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force a shuffle join
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(30000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0))
                                        .otherwise(F.col("id")).alias("k"))
        right = spark.range(30000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        hot = spark.createDataFrame([(0,)], "k long")
        out = hot_key_join(big, right, "k", hot, "left", 32)
        parts = (out.where(F.col("k") == 0).groupBy(F.spark_partition_id().alias("pid"))
                    .count().collect())
        assert len(parts) >= 8
        assert max(r["count"] for r in parts) < 10000 / 4
        assert out.count() == 30000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
