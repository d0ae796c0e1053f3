"""Splits, folds, resampling and class weights.

All randomness is a seeded md5 of the row key (see ``functions.hashing``), so
results do not depend on partitioning, retries or executor count, and the
SQL oracle reproduces them exactly.  Class-wise ranks use the bucketed rank of
``operators.order`` so a dominant class never sits in one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.hashing import hash_bucket, hash_int, seeded_hash
from wardline.operators.order import rank_in_order, rank_within, split_by_quota

# Hex digits of the hash used as rank buckets: 16^4 = 65,536 buckets per class.
BUCKET_DIGITS = 4
_H = "_wl_h"


def _fraction(x: float) -> Fraction:
    f = Fraction(str(x))  # the decimal that was written, exactly
    if not 0 <= f <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    return f


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n"))


def split_stratified(df: DataFrame, label: str = "label", key: str = "encounter_id",
                     test_size: float = 0.3, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Flag ``out`` = 1 for ceil(test_size * n_c) rows of every class c, the
    rows first in seeded-hash order; the rest 0.  Each class keeps its share
    within one row."""
    f = _fraction(test_size)

    def quota(totals: DataFrame) -> DataFrame:
        # ceil(n * p / q) in exact integer arithmetic
        return totals.select(label, F.expr(
            f"(n * {f.numerator} + {f.denominator - 1}) div {f.denominator}").alias("quota"))
    h = df.withColumn(_H, seeded_hash(seed, key))
    res = split_by_quota(h, [label], [_H, key], hash_bucket(F.col(_H), BUCKET_DIGITS), quota, out)
    return res.drop(_H)


def train_test(df: DataFrame, flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """(train, test) frames from a split flag."""
    return df.where(F.col(flag) == 0).drop(flag), df.where(F.col(flag) == 1).drop(flag)


def folds_stratified(df: DataFrame, k: int, label: str = "label", key: str = "encounter_id",
                     seed: int | None = 42, out: str = "fold") -> DataFrame:
    """Stratified k folds: ``out`` = (rank within class - 1) mod k, ranks in
    seeded-hash order; ``seed=None`` gives the unshuffled form, see
    :func:`folds_unshuffled`."""
    if k < 2:
        raise ValueError("k must be >= 2")
    if seed is None:
        return folds_unshuffled(df, k, label, key, out)
    h = df.withColumn(_H, seeded_hash(seed, key))
    ranked = rank_within(h, [label], [_H, key], hash_bucket(F.col(_H), BUCKET_DIGITS),
                         "_wl_rn").drop(_H)
    return ranked.withColumn(out, F.pmod(F.col("_wl_rn") - 1, F.lit(k)).cast("int")).drop("_wl_rn")


def folds_unshuffled(df: DataFrame, k: int, label: str = "label", key: str = "encounter_id",
                     out: str = "fold") -> DataFrame:
    """Stratified folds without shuffling: in key order each class is cut into
    k contiguous blocks.  Their sizes come from dealing all rows, sorted by
    class, to the folds in turn (classes in order of their first key), so fold
    sizes differ by one row at most."""
    ranked = rank_in_order(df, [label], [key], "_wl_rn")
    per = df.groupBy(F.col(label).alias("_wl_c")).agg(F.count(F.lit(1)).alias("_wl_n"), F.min(key).alias("_wl_first"))
    w = Window.orderBy("_wl_first").rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    per = per.withColumn("_wl_o", F.coalesce(F.sum("_wl_n").over(w), F.lit(0)))
    # rows of the class that folds 0..i get: places o..o+n-1 of the deal whose rest by k is at most i
    upto = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.aggregate(
        F.sequence(F.lit(0), i), F.lit(0).cast("long"),
        lambda a, j: a + F.floor((F.col("_wl_o") + F.col("_wl_n") - 1 - j + k) / k).cast("long")
        - F.floor((F.col("_wl_o") - 1 - j + k) / k).cast("long")))
    per = per.select("_wl_c", upto.alias("_wl_upto"))
    j = ranked.join(F.broadcast(per), F.col(label).eqNullSafe(F.col("_wl_c")))
    fold = F.size(F.filter("_wl_upto", lambda x: x < F.col("_wl_rn")))
    return j.withColumn(out, fold.cast("int")).drop("_wl_rn", "_wl_c", "_wl_upto")


def _minority_majority(df: DataFrame, label: str) -> tuple[object, int, object, int]:
    """Class counts (at most a handful of rows) -> (min_label, n_min, maj_label, n_maj)."""
    rows = sorted(class_counts(df, label).collect(), key=lambda r: (r["n"], str(r[label])))
    if len(rows) < 2:
        raise ValueError("resampling needs at least two classes")
    if len(rows) > 2:
        raise ValueError("resampling supports two classes")
    (lo, nlo), (hi, nhi) = (rows[0][label], rows[0]["n"]), (rows[-1][label], rows[-1]["n"])
    return lo, nlo, hi, nhi


def draw_counts(df_min: DataFrame, n_draws: int, n_min: int, key: str, seed: int, out: str = "times") -> DataFrame:
    """``df_min`` with ``out``: how many of ``n_draws`` draws with replacement
    pick the row.  Draw i picks the row of rank 1 + (hash_int(md5('seed:draw:i'))
    mod n_min) in seeded-hash order; draws are counted per rank before any join,
    so what is joined has one row per source row, however many are drawn."""
    spark = df_min.sparkSession
    h = df_min.withColumn(_H, seeded_hash(seed, key))
    ranked = rank_within(h, [], [_H, key], hash_bucket(F.col(_H), BUCKET_DIGITS), "_wl_rn").drop(_H)
    parts = max(1, min(n_draws // 1_000_000 + 1, 100_000))
    drawn = (spark.range(0, n_draws, numPartitions=parts)
             .select((F.pmod(hash_int(seeded_hash(seed, F.lit("draw"), F.col("id"))), F.lit(n_min)) + 1).alias("_wl_rn"))
             .groupBy("_wl_rn").agg(F.count(F.lit(1)).alias("_wl_t")))
    return (ranked.join(drawn, "_wl_rn", "left").withColumn(out, F.coalesce("_wl_t", F.lit(0)).cast("long"))
            .select(*[F.col(f"`{c}`") for c in df_min.columns], out))


def oversample_counts(df: DataFrame, label: str = "label", key: str = "encounter_id", seed: int = 42,
                      keep_original: bool = False, out: str = "times") -> DataFrame:
    """Random oversampling of the minority class to the majority size, as a
    multiplicity: every row of ``df`` with ``out``, the times the balanced set
    has it (1 for the majority).  No row is copied; a weighted fit reads it as
    it is.

    ``keep_original=False``: the minority is replaced by n_maj draws with
    replacement (resample-then-concat), so some rows have 0.  ``True``: all
    minority rows are kept and n_maj - n_min draws added (in-pipeline sampler)."""
    lo, n_min, hi, n_maj = _minority_majority(df, label)
    mino = df.where(F.col(label) == F.lit(lo))
    majo = df.where(F.col(label) != F.lit(lo)).withColumn(out, F.lit(1).cast("long"))
    drawn = draw_counts(mino, n_maj - n_min if keep_original else n_maj, n_min, key, seed, out)
    return majo.unionByName(drawn.withColumn(out, F.col(out) + 1) if keep_original else drawn)


def expand(df: DataFrame, times: str = "times") -> DataFrame:
    """Each row as often as ``times`` says, for methods that take no weights."""
    copies = F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    return df.withColumn("_wl_copy", copies).drop("_wl_copy", times)


def oversample(df: DataFrame, label: str = "label", key: str = "encounter_id", seed: int = 42,
               keep_original: bool = False) -> DataFrame:
    """The balanced rows themselves: :func:`oversample_counts`, expanded."""
    return expand(oversample_counts(df, label, key, seed, keep_original, "_wl_times"), "_wl_times")


def undersample(df: DataFrame, label: str = "label", key: str = "encounter_id",
                seed: int = 42) -> DataFrame:
    """Keep every minority row and n_min majority rows (first in hash order)."""
    lo, n_min, hi, n_maj = _minority_majority(df, label)
    spark = df.sparkSession
    quota = spark.createDataFrame([(hi, n_min), (lo, n_min)],
                                  f"{label} {df.schema[label].dataType.simpleString()}, quota long")
    h = df.withColumn(_H, seeded_hash(seed, key))
    res = split_by_quota(h, [label], [_H, key], hash_bucket(F.col(_H), BUCKET_DIGITS),
                         quota, "_wl_keep")
    return res.where(F.col("_wl_keep") == 1).drop("_wl_keep", _H)


def sample_n(df: DataFrame, n: int, key: str = "encounter_id", seed: int = 42) -> DataFrame:
    """Uniform sample of min(n, N) rows without replacement: the first n rows
    in seeded-hash order.  Works for any n (no single-task top-n)."""
    spark = df.sparkSession
    quota = spark.createDataFrame([(1, int(n))], "_wl_g int, quota long")
    h = df.withColumn(_H, seeded_hash(seed, key)).withColumn("_wl_g", F.lit(1))
    res = split_by_quota(h, ["_wl_g"], [_H, key], hash_bucket(F.col(_H), BUCKET_DIGITS),
                         quota, "_wl_keep")
    return res.where(F.col("_wl_keep") == 1).drop("_wl_keep", _H, "_wl_g")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with the balanced weight n_total / (n_classes * n_c)."""
    cc = class_counts(df, label)
    tot = cc.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    per_class = tot.select(F.col("t").cast("double") / F.col("k")).scalar()
    return cc.withColumn("weight", per_class / F.col("n"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced class weight to every row (broadcast: one row per class)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")
