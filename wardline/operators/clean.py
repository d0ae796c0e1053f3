"""Cleaning, schema and filter operators (DataFrame -> DataFrame)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.codes import binary_flag, sanitize_name

_STRING = (T.StringType, T.VarcharType, T.CharType)
_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (T.NumericType,)


def columns_by_type(df: DataFrame, kind: str) -> list[str]:
    """Column names of one kind: 'string', 'integer', 'numeric' or 'boolean'."""
    kinds = {"string": _STRING, "integer": _INTEGER, "numeric": _NUMERIC,
             "boolean": (T.BooleanType,)}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds[kind])]


def schema_table(df: DataFrame) -> DataFrame:
    """The schema as a small table (position, column, type)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def as_category(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Treat code/id columns as categories: cast to string (levels fitted later)."""
    cols = set(cols)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns; names not present are ignored."""
    return df.drop(*list(cols))


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`sanitize_name`; fail when two collide."""
    new = [sanitize_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {old!r} both sanitise to {n!r}")
        seen[n] = old
    return df.toDF(*new)


def split_by_suffix(df: DataFrame, suffix: str) -> tuple[list[str], list[str]]:
    """(columns ending with ``suffix``, the other columns)."""
    hit = [c for c in df.columns if c.endswith(suffix)]
    return hit, [c for c in df.columns if not c.endswith(suffix)]


def binary_target(df: DataFrame, col: str, positive, out: str = "label",
                  drop_source: bool = True) -> DataFrame:
    """0/1 target from a multi-level outcome (``col == positive``; missing -> 0)."""
    out_df = df.withColumn(out, binary_flag(col, positive))
    return out_df.drop(col) if drop_source and col != out else out_df


def yes_no_flags(df: DataFrame, positives: dict[str, str]) -> DataFrame:
    """Replace each column by 1 where it equals its positive value, else 0."""
    return df.withColumns({c: binary_flag(c, v) for c, v in positives.items()})


def replace_sentinel(df: DataFrame, sentinel: str = "?", value: str = "Unknown",
                     cols: list[str] | None = None) -> DataFrame:
    """Replace a sentinel string in every string column (or ``cols``)."""
    cols = cols if cols is not None else columns_by_type(df, "string")
    if not cols:
        return df
    return df.withColumns({c: F.when(F.col(f"`{c}`") == sentinel, F.lit(value))
                                .otherwise(F.col(f"`{c}`")) for c in cols})


def fill_other(df: DataFrame, cols: Iterable[str], value: str = "Other") -> DataFrame:
    """Missing values of the given columns become ``value``."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(value)) for c in cols})


def exclude_value(df: DataFrame, col: str, value) -> DataFrame:
    """Drop rows equal to ``value``; rows with a missing value are kept."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def exclude_codes(df: DataFrame, col: str, codes: Iterable) -> DataFrame:
    """NOT IN that keeps missing values (unlike SQL ``NOT IN``)."""
    return df.where(~F.coalesce(F.col(col).isin(list(codes)), F.lit(False)))


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (in ``cols`` or all columns)."""
    return df.na.drop("any", subset=cols)


def digits_only(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose value is made of decimal digits only."""
    return df.where(F.col(col).rlike("^[0-9]+$"))


def constant_column_names(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Columns holding at most one distinct value, NULL counted as a value.

    One pass of cheap partial aggregates (min, max, counts) – no distinct
    aggregation, which would expand every row once per column."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols if cols is not None else df.columns)
            if not isinstance(fields[c], (T.ArrayType, T.MapType, T.StructType))]
    if not cols:
        return []
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"_c{i}"), F.min(q).alias(f"_lo{i}"), F.max(q).alias(f"_hi{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        nn = row[f"_c{i}"]
        if nn == 0 or (nn == row["_n"] and row[f"_lo{i}"] == row[f"_hi{i}"]):
            out.append(c)
    return out


def drop_constant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop columns holding at most one distinct value (NULL counts as a value)."""
    return df.drop(*constant_column_names(df, cols))


def merge_levels(df: DataFrame, cols: Iterable[str],
                 levels=("Not Available", "NULL", "Not Mapped"), into: str = "Other") -> DataFrame:
    """Merge placeholder levels (after a lookup) into one level."""
    return df.withColumns({c: F.when(F.col(f"`{c}`").isin(list(levels)), F.lit(into))
                                .otherwise(F.col(f"`{c}`")) for c in cols})


def align_to(df: DataFrame, columns: list[str], fill=0) -> DataFrame:
    """Give ``df`` exactly ``columns`` in that order: missing ones filled with
    ``fill``, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in columns])


def shape_report(df: DataFrame, name: str = "frame") -> DataFrame:
    """(name, n_rows, n_cols) as a one-row frame."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
