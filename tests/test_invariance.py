"""Same results whatever the shuffle partitioning."""

import pytest

from wardline.operators import encode, metrics, sample


@pytest.fixture()
def frame(spark):
    rows = [(i, 1 if i % 5 == 0 else 0, (i * 37) % 101 / 100.0, i % 23) for i in range(1, 1201)]
    return spark.createDataFrame(rows, "encounter_id long, label int, p double, patient long")


def _set(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("op", ["folds", "oversample", "auc", "freq"])
def test_partition_invariance(spark, frame, op):
    def run(df):
        if op == "folds":
            return sample.folds_stratified(df, 4, seed=9).select("encounter_id", "fold")
        if op == "oversample":
            return sample.oversample(df.select("encounter_id", "label"), seed=9)
        if op == "auc":
            return metrics.roc_auc(df, partitions=8)
        return encode.frequency_encode(df, "patient", "f").select("encounter_id", "f")
    results = []
    for parts in (1, 4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        results.append(_set(run(frame.repartition(parts))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
