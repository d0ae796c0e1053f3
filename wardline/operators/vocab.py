"""One-hot encoding through a vocabulary that stays a table.

The vocabulary (column, level, idx) is joined to the rows, column by column,
and each row's sparse vector is put together from the positions it got.  No
level reaches the driver or the plan, only the width of each column, so a column
may have any number of levels; rare ones can be bucketed into one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.codes import NAME_SUBSTITUTIONS
from wardline.operators.order import scan_before
from wardline.session import checkpoint_dir, materialize

RARE = "Other"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def level_counts(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column, level, n) of every non-missing level.  One scan: the
    columns are unpivoted in the pipeline and counted before the shuffle."""
    if not cols:
        raise ValueError("no columns")
    keys = keys or []
    long = df.select(*[_q(k) for k in keys], *[_q(c).cast("string").alias(c) for c in cols]).unpivot(keys, cols, "column", "level")
    return (long.where(F.col("level").isNotNull()).groupBy(*keys, "column", "level")
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def index_levels(counts: DataFrame, keys: list[str] | None = None, min_count: int = 0) -> DataFrame:
    """(keys..., column, level, feature, idx): a level's place among the
    features of its column (and keys) in ascending order, from 0.

    A feature is a level, or ``RARE`` for all levels of fewer than ``min_count``
    rows.  Places come from a two-level scan, as one column may hold nearly all
    levels."""
    by = [*(keys or []), "column"]
    named = counts.withColumn("feature", F.when(F.col("n") >= min_count, F.col("level")).otherwise(F.lit(RARE)))
    features = scan_before(named.select(*by, "feature").distinct(), by, ["feature"], {"idx": F.lit(1)})
    return named.drop("n").join(features.withColumn("idx", F.col("idx").cast("int")), [*by, "feature"]).select(
        *by, "level", "feature", "idx")


def read_vectors(df: DataFrame, col: str, label: str) -> DataFrame:
    """``df`` written once, with the struct ``col`` (type, size, indices, values)
    read back as an ML vector: Parquet stores a vector as that struct."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark, local_default=True).rstrip('/')}/wardline-tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == col else f.dataType) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(path)


@dataclass
class SparseEncoder:
    """Numeric columns, then one block of one-hot positions per category column
    (features ascending, the first dropped or not).  ``vocab`` is (column,
    level, feature, idx); ``widths`` has one number per column."""

    numeric: list[str]
    categorical: list[str]
    vocab: DataFrame | None
    widths: dict[str, int]
    drop_first: bool = True

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(self.widths.values())

    def offsets(self) -> dict[str, int]:
        out, at = {}, len(self.numeric)
        for c in self.categorical:
            out[c] = at
            at += self.widths[c]
        return out

    def names(self, spark) -> DataFrame:
        """(idx, name): the feature names, as a table."""
        at, skip = self.offsets(), int(self.drop_first)
        out = spark.createDataFrame(list(enumerate(self.numeric)), "idx int, name string")
        if self.categorical:
            offset = F.element_at(F.create_map(*[F.lit(x) for c in self.categorical for x in (c, at[c])]), F.col("column"))
            out = out.unionByName(self.vocab.where(F.col("idx") >= skip).select(
                (F.col("idx") - skip + offset).cast("int").alias("idx"),
                sanitized(F.concat_ws("_", "column", "feature")).alias("name")).distinct())
        return out

    def entries(self, df: DataFrame, out: str = "entries") -> DataFrame:
        """``df`` with ``out``: an array of (idx, value), ascending by idx.  A
        baseline, unknown or missing level has no entry, nor has a zero; a
        missing number is NaN."""
        at, skip, j = self.offsets(), int(self.drop_first), df
        for i, c in enumerate(self.categorical):
            # Spark broadcasts a vocabulary whose size is known to be small
            part = self.vocab.where((F.col("column") == c) & (F.col("idx") >= skip)).select(
                F.col("level").alias(f"_wl_l{i}"), (F.col("idx") - skip + at[c]).cast("int").alias(f"_wl_i{i}"))
            j = j.join(part, _q(c).cast("string") == F.col(f"_wl_l{i}"), "left").drop(f"_wl_l{i}")
        entry = [F.struct(F.lit(i).cast("int").alias("idx"), F.coalesce(_q(c).cast("double"), F.lit(float("nan"))).alias("value"))
                 for i, c in enumerate(self.numeric)]
        entry += [F.struct(F.col(f"_wl_i{i}").alias("idx"), F.lit(1.0).alias("value")) for i in range(len(self.categorical))]
        packed = F.filter(F.array(*entry), lambda x: x["idx"].isNotNull() & (x["value"] != 0.0))
        return j.select(*[_q(c) for c in df.columns], packed.alias(out))

    def vectors(self, df: DataFrame, keep: list[str], out: str = "features", label: str = "features") -> DataFrame:
        """``keep`` and the sparse vector ``out`` of every row, as a table."""
        e = self.entries(df, "_wl_e")
        vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(self.size).cast("int").alias("size"),
                          F.transform("_wl_e", lambda x: x["idx"]).alias("indices"),
                          F.transform("_wl_e", lambda x: x["value"]).alias("values"))
        return read_vectors(e.select(*[_q(c) for c in keep], vector.alias(out)), out, label)


def sanitized(name: Column) -> Column:
    """:func:`sanitize_name` as a column expression."""
    for a, b in NAME_SUBSTITUTIONS:
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def encoder(vocab: DataFrame | None, categorical: list[str], numeric: list[str], drop_first: bool = True) -> SparseEncoder:
    """An encoder over a vocabulary (column, level, feature, idx); only the
    width of each column is collected.  A column without levels, or with only
    the dropped one, has no width."""
    widths = dict.fromkeys(categorical, 0)
    if categorical:
        for r in vocab.groupBy("column").agg(F.max("idx").alias("top")).collect():  # one row per column
            if r["column"] in widths:
                widths[r["column"]] = max(r["top"] + 1 - int(drop_first), 0)
    return SparseEncoder(list(numeric), list(categorical), vocab, widths, drop_first)


def fit_encoder(train: DataFrame, categorical: list[str], numeric: list[str], drop_first: bool = True,
                min_count: int = 0) -> SparseEncoder:
    """Fit the vocabulary on ``train``; levels of fewer than ``min_count`` rows
    share one position."""
    vocab = None
    if categorical:
        vocab = materialize(index_levels(level_counts(train, categorical), min_count=min_count), "vocabulary")
    return encoder(vocab, categorical, numeric, drop_first)
