"""Rules at the edges: NULL groups, one-level columns, contiguous folds, draws beyond 32 bits."""

import math

import pytest
from pyspark.sql import functions as F

from wardline.functions.hashing import hash_int, seeded_hash
from wardline.operators import encode, lookup, metrics, models, neighbors, report, sample, vocab
from wardline.sources import sinks


def blocks(labels, k):
    """Unshuffled stratified folds: rows sorted by class (in order of first
    appearance) are dealt to the folds; each class then fills its shares in order."""
    order = sorted(set(labels), key=labels.index)
    dealt = [c for c in order for _ in range(labels.count(c))]
    share = {c: [dealt[i::k].count(c) for i in range(k)] for c in order}
    seen, out = dict.fromkeys(order, 0), []
    for c in labels:
        left, fold = seen[c], 0
        while left >= share[c][fold]:
            left -= share[c][fold]
            fold += 1
        out.append(fold)
        seen[c] += 1
    return out


@pytest.mark.parametrize("key", ["long", "string"])
def test_unshuffled_folds_are_contiguous_blocks(spark, key):
    labels = [1 if i % 5 == 3 else 0 for i in range(47)]
    df = spark.createDataFrame([(f"k{i:03d}" if key == "string" else (i + 1) * 10 ** 12, y) for i, y in enumerate(labels)],
                               f"id {key}, label int")
    got = [r["fold"] for r in sample.folds_stratified(df, 5, "label", "id", None).orderBy("id").collect()]
    assert got == blocks(labels, 5)


def test_small_split_fractions_are_exact():
    assert sample._fraction(0.0000003).numerator == 3 and sample._fraction(0.1).denominator == 10


def test_draws_exceed_32_bits(spark):
    top = spark.range(200).select(F.max(hash_int(seeded_hash(1, F.col("id"))))).first()[0]
    assert top > 1 << 40


def test_zero_share_counts_missing_rows(spark):
    df = spark.createDataFrame([(0,), (None,), (1,), (None,)], "v int")
    assert report.zero_share(df, ["v"]).first()["zero_share"] == 0.25


def test_dense_class_counts_fill_gaps(spark):
    df = spark.createDataFrame([(0,), (3,), (3,)], "label int")
    assert sorted(tuple(r) for r in report.class_counts_dense(df).collect()) == [(0, 1), (1, 0), (2, 0), (3, 2)]
    assert report.class_counts_dense(df.limit(0)).count() == 0


def test_null_group_keeps_its_metrics(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.2), ("a", 1, 0.3), ("a", 0, 0.6), ("a", 0, None)],
                               "g string, label int, p double")
    sweep = {r["g"]: r for r in metrics.threshold_sweep(df, [0.5], group=["g"], beta=2.0).collect()}
    assert (sweep[None]["tp"], sweep[None]["fn"], sweep[None]["fbeta"]) == (1, 0, 1.0)
    assert (sweep["a"]["tp"], sweep["a"]["fp"], sweep["a"]["fn"]) == (0, 1, 1)
    auc = {r["g"]: r["auc"] for r in metrics.evaluate(df, group=["g"]).collect()}
    assert auc == {None: 1.0, "a": 0.0}  # the row without a score is left out


def test_one_level_column_has_no_width(spark):
    df = spark.createDataFrame([("x", "u", 1.0), ("x", "v", 2.0), (None, "v", 3.0)], "a string, b string, n double")
    enc = vocab.fit_encoder(df, ["a", "b"], ["n"])
    assert [r["name"] for r in enc.names(spark).orderBy("idx").collect()] == ["n", "b_v"]
    assert [list(r["features"].toArray()) for r in enc.vectors(df, ["n"]).orderBy("n").collect()] == [[1, 0], [2, 1], [3, 1]]


def test_broken_model_raises_and_missing_one_falls_back(spark, tmpdir_path):
    assert sinks.load_model(tmpdir_path + "/none", fallback="kept") == "kept"
    spark.createDataFrame([("not a model",)], "value string").write.text(tmpdir_path + "/broken/metadata")
    with pytest.raises(Exception):
        sinks.load_model(tmpdir_path + "/broken", fallback="kept")


def test_smote_rejects_missing_or_infinite_features(spark):
    rows = [(i, int(i < 4), [float(i), math.nan if i == 1 else 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "key long, label int, features array<double>")
    with pytest.raises(ValueError):
        neighbors.smote(df, k=2)


@pytest.mark.parametrize("balance,n", [("replace", 24), ("smote", 24), ("resample", 24)])
def test_balancers_fit_on_equal_classes(spark, balance, n):
    rows = [(i, int(i < 4), float(i % 3), float(i)) for i in range(16)]
    df = encode.assemble(spark.createDataFrame(rows, "key long, label int, x double, y double"), ["x", "y"])

    class Seen:
        def fit(self, train):
            return {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert models.fit_balanced(df, Seen(), balance) == {0: 12, 1: n - 12}


def test_deeper_trees_than_spark_has_are_refused():
    with pytest.raises(ValueError):
        models.forest(max_depth=31)


def test_lookup_sections_span_position_buckets(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BUCKET", 3)
    lines = ["a_id,description"] + [f"{i},A{i}" for i in range(8)] + ["b_id,description", "0,B0", "x", "1,\"B, one\""]
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, line string")
    got = [tuple(r) for r in lookup.parse_stacked_lookup(df).orderBy("pos").select("section", "code", "description").collect()]
    assert got == [("a_id", str(i), f"A{i}") for i in range(8)] + [("b_id", "0", "B0"), ("b_id", "1", "B, one")]
