"""Encoders.  Anything fitted (shares, vocabularies, scaler statistics) is a
small DataFrame, fitted on a ``fit_on`` frame (train by default in the
pipeline, so nothing leaks from test rows) and applied to any frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import (
    dose_ordinal, icd_coarse_from_root, icd_fine_from_root, icd_root,
)
from wardline.operators.joins import hot_key_join
from wardline.operators.vocab import index_levels, level_counts
from wardline.session import materialize

# Share from which a level counts as heavy for join salting: at most
# 1 / HOT_SHARE levels can reach it, so the hot-key set has a proven bound.
HOT_SHARE = 1e-4


def _q(c: str):
    return F.col(f"`{c}`")


def encode_ordinal(df: DataFrame, cols: list[str]) -> DataFrame:
    """Dose flags No/Down/Steady/Up -> 0/1/2/3 (else NULL) in one projection."""
    return df.withColumns({c: dose_ordinal(_q(c)) for c in cols})


def group_codes(df: DataFrame, cols: list[str], fine: bool = False,
                suffix: str = "_cat", drop_source: bool = True) -> DataFrame:
    """ICD-9 grouping of diagnosis columns into ``<col><suffix>``."""
    f = icd_fine_from_root if fine else icd_coarse_from_root
    # the integer root is computed once per column, then grouped
    roots = {f"_wl_root_{i}": icd_root(_q(c)) for i, c in enumerate(cols)}
    out = df.withColumns(roots).withColumns(
        {c + suffix: f(F.col(f"_wl_root_{i}")) for i, c in enumerate(cols)}).drop(*roots)
    return out.drop(*cols) if drop_source else out


def level_shares(df: DataFrame, col: str) -> DataFrame:
    """(level, n, share) per non-missing level; share = n / non-missing rows.

    Partial aggregation combines map-side, so a level holding a third of the
    rows costs no more than any other; the total is a scalar subquery.  The
    per-level counts are written once: the salted join and the total read them
    several times, so the input is scanned for them once."""
    counts = materialize(df.where(_q(col).isNotNull()).groupBy(_q(col).alias(col)).agg(
        F.count(F.lit(1)).cast("long").alias("n")), "levels")
    total = counts.agg(F.sum("n"))
    return counts.withColumn("share", F.col("n") / total.scalar())


def frequency_encode(df: DataFrame, col: str, out: str | None = None,
                     fit_on: DataFrame | None = None, drop_source: bool = False) -> DataFrame:
    """Add ``out`` = share of rows holding this row's level of ``col``
    (levels unseen in ``fit_on`` get NULL).  Heavy levels are salted."""
    out = out or f"{col}_freq"
    shares = level_shares(fit_on if fit_on is not None else df, col)
    right = shares.select(col, F.col("share").alias(out))
    hot = shares.where(F.col("share") >= HOT_SHARE).select(col)
    res = hot_key_join(df, right, col, hot, "left")
    res = res.select(*df.columns, out)
    return res.drop(col) if drop_source else res


def rare_bucket(df: DataFrame, col: str, min_share: float | None = 0.01,
                min_count: int | None = None, other: str = "Other",
                out: str | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Keep levels with share >= ``min_share`` (or count >= ``min_count``);
    others and missing become ``other``.  Result is a string column.

    By share, at most 1/min_share levels survive; they are broadcast if that is
    a bound of at most 1/HOT_SHARE.  By count, or a smaller share, the kept set
    grows with the data and is joined with salting."""
    out = out or col
    shares = level_shares(fit_on if fit_on is not None else df, col)
    keep_col = "_wl_keep"
    if min_count is None and min_share >= HOT_SHARE:
        major = shares.where(F.col("share") >= min_share).select(
            col, _q(col).cast("string").alias(keep_col))
        j = df.join(F.broadcast(major), col, "left")
    else:
        enough = F.col("n") >= min_count if min_count is not None else F.col("share") >= min_share
        major = shares.where(enough).select(
            col, _q(col).cast("string").alias(keep_col))
        hot = shares.where(F.col("share") >= HOT_SHARE).select(col)
        j = hot_key_join(df, major, col, hot, "left")
    j = j.withColumn(out, F.coalesce(F.col(keep_col), F.lit(other)))
    cols = list(df.columns) + ([out] if out not in df.columns else [])
    return j.select(*[_q(c) for c in cols])


# ---------------------------------------------------------------- one-hot

def fit_vocabulary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, level, n, idx) for every non-missing level, ``idx`` 0-based in
    ascending level order, as a table.  For 0/1 columns collect it with
    :func:`vocabulary_levels`; sparse vectors need no collected levels
    (``vocab.fit_encoder``)."""
    counts = materialize(level_counts(df, cols), "levels")
    return materialize(counts.join(index_levels(counts), ["column", "level"]).select("column", "level", "n", "idx"), "vocabulary")


def vocabulary_levels(vocab: DataFrame, max_levels: int = 1000) -> dict[str, list[str]]:
    """Collect a fitted vocabulary for 0/1 columns, which a schema has to name:
    the number of levels per column is checked first (a small aggregate), then
    at most ``max_levels`` per column reach the driver.  A column with more is
    refused; ``vocab.fit_encoder`` encodes any number as a sparse vector."""
    sizes = {r["column"]: r["k"] for r in
             vocab.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    too_big = sorted(c for c, k in sizes.items() if k > max_levels)
    if too_big:
        raise ValueError(f"columns with more than {max_levels} levels: {too_big}; "
                         f"bucket rare levels, or encode them by vocab.fit_encoder")
    out: dict[str, list[str]] = {}
    for r in sorted(vocab.select("column", "level").collect(),
                    key=lambda r: (r["column"], r["level"])):
        out.setdefault(r["column"], []).append(r["level"])
    return out


def dummy_name(col: str, level: str, sep: str = "_") -> str:
    return f"{col}{sep}{level}"


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True,
            sep: str = "_", keep_source: bool = False) -> DataFrame:
    """0/1 columns ``<col>_<level>`` from a fitted vocabulary, in level order;
    ``drop_first`` skips the first level (the baseline).  Unknown and
    missing levels give all zeros.  Other columns keep their place; dummies
    follow, as the tabular convention has it."""
    dummies = []
    for c, lv in levels.items():
        for level in (lv[1:] if drop_first else lv):
            dummies.append(_q(c).cast("string").eqNullSafe(F.lit(level)).cast("int")
                           .alias(dummy_name(c, level, sep)))
    base = [_q(c) for c in df.columns if keep_source or c not in levels]
    return df.select(*base, *dummies)


def feature_names(levels: dict[str, list[str]], numeric: list[str], drop_first: bool = True,
                  sep: str = "_") -> list[str]:
    """Ordered output feature names of :func:`one_hot` plus numeric columns."""
    names = list(numeric)
    for c, lv in levels.items():
        names += [dummy_name(c, level, sep) for level in (lv[1:] if drop_first else lv)]
    return names


def inverse_one_hot(df: DataFrame, col: str, levels: list[str], fallback: str,
                    sep: str = "_", drop_dummies: bool = True) -> DataFrame:
    """Rebuild ``col`` from keep-all dummy columns: the first level holding the
    row's largest value; a row of zeros gets ``fallback`` (the training mode)."""
    names = [dummy_name(col, lv, sep) for lv in levels]
    m = F.greatest(*[_q(n).cast("double") for n in names]) if len(names) > 1 \
        else _q(names[0]).cast("double")
    expr = F.when(m <= 0, F.lit(fallback))
    for n, lv in zip(names, levels):
        expr = expr.when(_q(n).cast("double") == m, F.lit(lv))
    res = df.withColumn(col, expr.otherwise(F.lit(fallback)))
    return res.drop(*names) if drop_dummies else res


# ---------------------------------------------------------------- scaling

def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, sd) with the population standard deviation, one pass."""
    aggs = []
    for c in cols:
        x = _q(c).cast("double")
        aggs += [F.avg(x).alias(f"m__{c}"), F.stddev_pop(x).alias(f"s__{c}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `m__{c}`, `s__{c}`" for c in cols)
    return one.select(F.expr(f"stack({len(cols)}, {stack}) as (column, mean, sd)"))


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - mean) / sd, with sd 0 or missing treated as 1 (a constant column
    becomes 0).  The statistics table has one row per column."""
    st = {r["column"]: (r["mean"], r["sd"]) for r in stats.collect()}
    exprs = {}
    for c, (m, s) in st.items():
        sd = 1.0 if (s is None or s == 0.0) else float(s)
        exprs[c] = (_q(c).cast("double") - F.lit(float(m or 0.0))) / F.lit(sd)
    return df.withColumns(exprs)


def scale_population(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fit the population scaler on ``fit_on`` (default ``df``) and apply it."""
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols))


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Pack numeric columns into an ML vector column (JVM-side)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)
