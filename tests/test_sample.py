import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.functions.hashing import seeded_hash
from wardline.operators import sample
from wardline.operators.order import rank_within


@pytest.fixture()
def labelled(spark):
    rows = [(i, 1 if i % 9 == 0 else 0) for i in range(1, 901)]
    return spark.createDataFrame(rows, "encounter_id long, label int")


def _set(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_split_partition_and_shares(labelled):
    s = sample.split_stratified(labelled, test_size=0.3, seed=7)
    assert s.count() == 900
    counts = {(r["label"], r["is_test"]): r["n"] for r in
              s.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    for lab, n in ((0, 800), (1, 100)):
        assert counts[(lab, 1)] == math.ceil(0.3 * n)
        assert counts[(lab, 0)] == n - math.ceil(0.3 * n)


def test_split_same_for_any_partitioning(spark, labelled):
    ref = _set(sample.split_stratified(labelled, seed=3), ["encounter_id", "is_test"])
    for parts in (1, 4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = _set(sample.split_stratified(labelled.repartition(parts), seed=3),
                   ["encounter_id", "is_test"])
        assert got == ref
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_rank_within_equals_row_number(spark, labelled):
    h = labelled.withColumn("h", seeded_hash(5, "encounter_id"))
    a = rank_within(h, ["label"], ["h", "encounter_id"], F.substring("h", 1, 2), "rn")
    b = h.withColumn("rn", F.row_number().over(
        Window.partitionBy("label").orderBy("h", "encounter_id")))
    assert _set(a, ["encounter_id", "rn"]) == _set(b, ["encounter_id", "rn"])


def test_folds_cover_and_balance(labelled):
    f = sample.folds_stratified(labelled, 4, seed=1)
    assert f.count() == 900 and f.select("encounter_id").distinct().count() == 900
    per = f.groupBy("label", "fold").count().collect()
    for lab in (0, 1):
        sizes = [r["count"] for r in per if r["label"] == lab]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    u = sample.folds_stratified(labelled, 5, seed=None)
    first = u.where((F.col("label") == 0) & (F.col("fold") == 0)).agg(F.min("encounter_id")).first()[0]
    assert first == 1


def test_oversample_balanced_and_submultiset(labelled):
    o = sample.oversample(labelled, seed=11)
    c = {r["label"]: r["count"] for r in o.groupBy("label").count().collect()}
    assert c[0] == c[1] == 800
    mino = {r[0] for r in labelled.where("label = 1").select("encounter_id").collect()}
    drawn = [r[0] for r in o.where("label = 1").select("encounter_id").collect()]
    assert set(drawn) <= mino
    k = sample.oversample(labelled, seed=11, keep_original=True)
    assert k.where("label = 1").count() == 800
    assert mino <= {r[0] for r in k.where("label = 1").select("encounter_id").collect()}


def test_oversample_one_class_errors(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "encounter_id long, label int")
    with pytest.raises(ValueError):
        sample.oversample(df)


def test_undersample_and_sample_n(labelled):
    u = sample.undersample(labelled, seed=2)
    c = {r["label"]: r["count"] for r in u.groupBy("label").count().collect()}
    assert c == {0: 100, 1: 100}
    s = sample.sample_n(labelled, 37, seed=4)
    assert s.count() == 37 and s.select("encounter_id").distinct().count() == 37
    assert sample.sample_n(labelled, 5000).count() == 900


def test_class_weights(labelled):
    w = {r["label"]: r["weight"] for r in sample.class_weights(labelled).collect()}
    assert w[0] == pytest.approx(900 / (2 * 800))
    assert w[1] == pytest.approx(900 / (2 * 100))


def test_running_before_hot_entity_matches_window(spark):
    from wardline.operators.order import running_before
    rows = [(i, 0 if i % 3 == 0 else i % 50, i % 4) for i in range(1500)]   # entity 0: a third
    df = spark.createDataFrame(rows, "id long, ent long, v long")
    got = running_before(df, "ent", "id", "id", ["v"], partitions=16)
    w = Window.partitionBy("ent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("id", F.count(F.lit(1)).over(w).alias("prior_n"),
                     F.coalesce(F.sum("v").over(w), F.lit(0)).alias("v_prior"))
    assert _set(got, ["id", "prior_n", "v_prior"]) == _set(want, ["id", "prior_n", "v_prior"])


def test_split_keeps_null_label_rows(spark):
    rows = [(i, None if i % 10 == 0 else i % 2) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "encounter_id long, label int")
    s = sample.split_stratified(df, test_size=0.3, seed=1)
    assert s.count() == 100
    n_null_test = s.where(F.col("label").isNull() & (F.col("is_test") == 1)).count()
    assert n_null_test == 3          # ceil(0.3 * 10): NULL is its own stratum
    f = sample.folds_stratified(df, 3, seed=1)
    assert f.count() == 100
