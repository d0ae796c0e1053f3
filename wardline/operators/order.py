"""Exact ranks and running sums without a single-task window.

A window ``partitionBy(label).orderBy(...)`` sends a whole class to one task;
with one class holding most rows that task holds most of the data.  Two ways
round that, both exact:

* Orders by a hash, in a few groups (classes): the hash prefix cuts the order
  into buckets; counts per (group, bucket) – a small table – become offsets, and
  ranks are taken inside each bucket.
* Any order, any number and size of groups: :func:`scan_before`, a two-level
  scan over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialize

_B = "_wl_bucket"
_OFF = "_wl_offset"
_P = "_wl_range"


def _join_ns(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner",
             broadcast: bool = True) -> DataFrame:
    """Join on ``cols`` with NULL-safe equality (a NULL group is a group, not
    a lost row); the right side's key columns are dropped."""
    r = right.select(*[F.col(c).alias(f"_wl_r_{c}") if c in cols else F.col(c)
                       for c in right.columns])
    cond = [left[c].eqNullSafe(r[f"_wl_r_{c}"]) for c in cols]
    out = left.join(F.broadcast(r) if broadcast else r, cond, how)
    return out.drop(*[f"_wl_r_{c}" for c in cols])


def _offsets(df: DataFrame, group_cols: list[str], sums: dict[str, Column],
             keep: bool = False) -> DataFrame:
    """Per (group, bucket): exclusive running totals of ``sums`` across buckets
    (``keep`` also returns the bucket's own totals)."""
    counts = df.groupBy(*group_cols, _B).agg(*[e.alias(n) for n, e in sums.items()])
    w = (Window.partitionBy(*group_cols).orderBy(_B)
         .rowsBetween(Window.unboundedPreceding, -1))
    out = counts
    for n in sums:
        out = out.withColumn(_OFF + n, F.coalesce(F.sum(n).over(w), F.lit(0)))
    return out if keep else out.drop(*sums.keys())


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                bucket: Column, rank_col: str = "rn") -> DataFrame:
    """Add ``rank_col`` = 1-based row number within ``group_cols`` ordered by
    ``order_cols`` (which must be unique within a group).  ``bucket`` must be
    monotone non-decreasing in that order, e.g. ``hash_bucket(h, 4)``.
    Group columns must not be NULL."""
    b = df.withColumn(_B, bucket)
    offs = _offsets(b, group_cols, {"n": F.count(F.lit(1))})
    j = _join_ns(b, offs, [*group_cols, _B])
    w = Window.partitionBy(*group_cols, _B).orderBy(*order_cols)
    return (j.withColumn(rank_col, (F.col(_OFF + "n") + F.row_number().over(w)).cast("long"))
             .drop(_B, _OFF + "n"))


def split_by_quota(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   bucket: Column, quota, flag_col: str) -> DataFrame:
    """``flag_col`` = 1 for the first ``quota`` rows of each group in the given
    order, else 0.  ``quota`` is a small frame (group_cols..., ``quota``) or a
    function from the group totals (group_cols..., ``n``) to such a frame, so
    the totals come from the bucket table instead of another scan.

    Buckets entirely inside or outside the quota are decided by the broadcast
    bucket table alone; only the one boundary bucket per group is ranked, so
    the bulk of the data is never shuffled."""
    b = df.withColumn(_B, bucket)
    offs = materialize(_offsets(b, group_cols, {"_wl_cnt": F.count(F.lit(1))}, keep=True), "offsets")
    if callable(quota):
        quota = quota(offs.groupBy(*group_cols).agg(F.sum("_wl_cnt").cast("long").alias("n")))
    dec = (_join_ns(offs.withColumnRenamed(_OFF + "_wl_cnt", _OFF + "n"), quota, group_cols,
                    "left")
           .withColumn("_wl_q", F.coalesce(F.col("quota"), F.lit(0)))
           .withColumn("_wl_dec",
                       F.when(F.col(_OFF + "n") + F.col("_wl_cnt") <= F.col("_wl_q"), F.lit(1))
                        .when(F.col(_OFF + "n") >= F.col("_wl_q"), F.lit(0))
                        .otherwise(F.lit(None).cast("int")))
           .select(*group_cols, _B, _OFF + "n", "_wl_q", "_wl_dec"))
    j = _join_ns(b, dec, [*group_cols, _B])
    sure = j.where(F.col("_wl_dec").isNotNull()).withColumn(flag_col, F.col("_wl_dec"))
    w = Window.partitionBy(*group_cols, _B).orderBy(*order_cols)
    edge = (j.where(F.col("_wl_dec").isNull())
             .withColumn(flag_col, ((F.col(_OFF + "n") + F.row_number().over(w))
                                    <= F.col("_wl_q")).cast("int")))
    return (sure.unionByName(edge)
                .drop(_B, _OFF + "n", "_wl_q", "_wl_dec"))


def scan_before(df: DataFrame, group_cols: list[str], order_cols: list[str],
                sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Add, per row, the sum of each expression in ``sums`` over the rows of its
    group that come before it in the order of ``order_cols`` (0 if none).

    A two-level scan: rows are range-partitioned by (group, order), so a group
    of any size lies in neighbouring partitions; each partition hands on the
    total of its last group, the only one that can go on in the next; and the
    running sums are taken inside the partitions.  What is broadcast has one
    row per partition.  The ranges come from Spark's own sample of the keys, so
    neither many small groups nor one that holds all rows needs a setting.
    NULL groups are groups; rows that tie in all of ``order_cols`` come one
    after the other in no defined order.  ``partitions`` sets the number of
    ranges (default: Spark's shuffle partitions)."""
    values = {f"_wl_v{i}": e for i, e in enumerate(sums.values())}
    groups = list(group_cols) or ["_wl_one"]
    keyed = df.withColumns(values)
    if not group_cols:
        keyed = keyed.withColumn("_wl_one", F.lit(1))
    by = [F.col(f"`{c}`") for c in [*groups, *order_cols]]
    dealt = keyed.repartitionByRange(partitions, *by) if partitions else keyed.repartitionByRange(*by)
    table = materialize(dealt.withColumn(_P, F.spark_partition_id()), "ranges")

    group = F.struct(*[F.col(f"`{c}`") for c in groups])
    per = table.groupBy(_P, *[F.col(f"`{c}`") for c in groups]).agg(*[F.sum(v).alias(v) for v in values])
    ends = per.groupBy(_P).agg(F.min(group).alias("lo"), F.max(group).alias("hi"),
                               *[F.max_by(v, group).alias(v) for v in values])
    # one row per partition from here to the broadcast
    run = Window.partitionBy("hi").orderBy(_P).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(_P, "lo", "hi", *[F.sum(v).over(run).alias(v) for v in values])
    last = Window.orderBy(_P)
    carry = ends.select(F.col(_P).alias("_wl_of"), "lo", *[
        F.when(F.lag("hi").over(last).eqNullSafe(F.col("lo")), F.lag(v).over(last)).alias(f"{v}_in") for v in values])
    j = table.join(F.broadcast(carry), F.col(_P) == F.col("_wl_of"))
    inside = (Window.partitionBy(_P, *[F.col(f"`{c}`") for c in groups]).orderBy(*[F.col(f"`{c}`") for c in order_cols])
              .rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0)
    return j.select(*[F.col(f"`{c}`") for c in df.columns], *[
        (F.coalesce(F.when(group == F.col("lo"), F.col(f"{v}_in")), zero)
         + F.coalesce(F.sum(v).over(inside), zero)).alias(n) for n, v in zip(sums, values)])


def rank_in_order(df: DataFrame, group_cols: list[str], order_cols: list[str], rank_col: str = "rn",
                  partitions: int | None = None) -> DataFrame:
    """Add ``rank_col``: the 1-based row number within the group, by a scan."""
    out = scan_before(df, group_cols, order_cols, {rank_col: F.lit(1).cast("long")}, partitions)
    return out.withColumn(rank_col, F.col(f"`{rank_col}`") + 1)


def running_before(df: DataFrame, entity: str, order_col: str, tie_col: str,
                   values: list[str], partitions: int | None = None) -> DataFrame:
    """Per-entity history before each row: ``prior_n`` (earlier rows of the
    same entity in (order_col, tie_col) order) and ``<v>_prior`` (their sum of
    each value column, 0 when none).  Rows without an entity are one entity."""
    order = [order_col] if tie_col == order_col else [order_col, tie_col]
    sums = {"prior_n": F.lit(1).cast("long"), **{f"{v}_prior": F.col(f"`{v}`") for v in values}}
    return scan_before(df, [entity], order, sums, partitions)
