"""Descriptive reports: counts, shares, rates, modes, top-k.

Groupings use partial aggregation; totals are scalar subqueries; nothing is
gathered in the driver except the bounded top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.order import running_before


def _q(c: str):
    return F.col(f"`{c}`")


def value_counts(df: DataFrame, cols: list[str] | str, normalize: bool = False) -> DataFrame:
    """(cols..., n[, share]) over rows with no missing value in ``cols``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    nn = df
    for c in cols:
        nn = nn.where(_q(c).isNotNull())
    out = nn.groupBy(*[_q(c).alias(c) for c in cols]).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    if normalize:
        out = out.withColumn("share", F.col("n") / out.agg(F.sum("n")).scalar())
    return out


def value_counts_sorted(df: DataFrame, cols: list[str] | str) -> DataFrame:
    """Value counts ordered by count descending, then by the values."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return value_counts(df, cols).orderBy(F.desc("n"), *cols)


def positive_rate(df: DataFrame, label: str = "label", group: list[str] | None = None,
                  digits: int = 3) -> DataFrame:
    """Share of positives (rounded) per group."""
    g = group or []
    return df.groupBy(*g).agg(F.round(F.avg(F.col(label).cast("double")), digits)
                              .alias("positive_rate"),
                              F.count(F.lit(1)).cast("long").alias("n"))


def class_counts_dense(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) for every integer class 0..max, zeros included."""
    counts = df.groupBy(F.col(label).cast("long").alias(label)).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    hi = counts.agg(F.max(label).alias("hi")).first()["hi"]
    grid = df.sparkSession.range(0 if hi is None else hi + 1).select(F.col("id").alias(label))
    return (grid.join(counts, label, "left")
                .select(label, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def distinct_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct non-missing classes, ascending."""
    return df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label)


def mode_level(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """Most frequent non-missing level (smallest level among ties) per group."""
    g = group or []
    counts = (df.where(_q(col).isNotNull())
                .groupBy(*g, _q(col).alias(col)).agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy(*g).agg(
        F.min_by(_q(col), F.struct(-F.col("_n"), _q(col))).alias("mode"),
        F.max("_n").cast("long").alias("n"))


def mean_std(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation per group."""
    g = group or []
    return df.groupBy(*g).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))


def mean_abs(long_df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, importance) = mean absolute value per feature, long form input."""
    return long_df.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("importance"))


def group_share(df: DataFrame, col: str, level) -> DataFrame:
    """Share of all rows holding one level of ``col`` (missing rows count in the total)."""
    return df.agg((F.sum(_q(col).eqNullSafe(F.lit(level)).cast("long"))
                   / F.count(F.lit(1))).alias("share"))


def rate_by_group(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """(group, n, positives, rate, share): outcome rate and size share per level."""
    a = df.groupBy(_q(group).alias(group)).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum(F.col(label).cast("long")).alias("positives"))
    tot = a.agg(F.sum("n")).scalar()
    return a.select(group, "n", "positives", (F.col("positives") / F.col("n")).alias("rate"),
                    (F.col("n") / tot).alias("share"))


def zero_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, zero_share): fraction of all rows equal to 0 (a missing value is
    not), one pass for all columns."""
    one = df.agg(*[F.avg(F.coalesce(_q(c) == 0, F.lit(False)).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return one.select(F.expr(f"stack({len(cols)}, {stack}) as (column, zero_share)"))


def entity_history(df: DataFrame, entity: str, numeric: list[str],
                   label: str | None = None) -> DataFrame:
    """Per-entity history across its rows: count and per-column sum / mean /
    max (and outcome rate).  One partially-aggregated pass, so an entity with a
    third of all rows costs no more than others."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows")]
    for c in numeric:
        aggs += [F.sum(_q(c)).alias(f"{c}_sum"), F.avg(_q(c)).alias(f"{c}_mean"),
                 F.max(_q(c)).alias(f"{c}_max")]
    if label:
        aggs.append(F.avg(F.col(label).cast("double")).alias("label_rate"))
    return df.groupBy(_q(entity).alias(entity)).agg(*aggs)


def entity_prior(df: DataFrame, entity: str, order_col: str, tie_col: str,
                 values: list[str]) -> DataFrame:
    """History before the current row: earlier rows of the same entity
    (``prior_n``) and running sums of ``values`` (``<v>_prior``), by a two-level
    scan (``order.running_before``), so no entity is too heavy or too rare."""
    return running_before(df, entity, order_col, tie_col, values)


def top_k(df: DataFrame, k: int, by: str = "importance", tie: str = "feature") -> DataFrame:
    """Top-k rows by ``by`` descending with a unique tie-break (a bounded
    TakeOrderedAndProject)."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def first_n(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows in key order."""
    return df.orderBy(key).limit(n)


def preview(df: DataFrame, n: int = 5, key: str | None = None) -> DataFrame:
    """A few rows for eyeballing (ordered by ``key`` when given)."""
    return (df.orderBy(key) if key else df).limit(n)
