"""Models on disjoint column sets, fitted on one split, scored in one pass and
voted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import explain, models, vocab

#: Adds its probability column (the given name) to a frame that has its columns.
Score = Callable[[DataFrame, str], DataFrame]
#: Fits a model on the label and some columns of the training rows.
Fit = Callable[[DataFrame, list[str]], Score]


@dataclass
class Branch:
    name: str
    columns: list[str]
    score: Score


def fit_branches(train: DataFrame, columns: dict[str, list[str]], fits: dict[str, Fit]) -> list[Branch]:
    """One model per branch, each on its own columns of the same training rows."""
    taken: set[str] = set()
    for name, cols in columns.items():
        if not cols or taken & set(cols):
            raise ValueError(f"branch {name!r} needs columns of its own")
        taken |= set(cols)
    return [Branch(n, c, fits[n](train, c)) for n, c in columns.items()]


def vote(df: DataFrame, branches: list[Branch], weights: dict[str, float], out: str = "p") -> DataFrame:
    """``df`` with ``p_<branch>`` of every branch and ``out``, their weighted
    mean.  The rows pass once: each branch adds its column, nothing is joined."""
    for b in branches:
        df = b.score(df, f"p_{b.name}")
    total = sum(weights[b.name] for b in branches)
    mean = sum((F.lit(weights[b.name]) * F.col(f"p_{b.name}") for b in branches), F.lit(0.0)) / F.lit(total)
    return df.withColumn(out, mean)


def level_rates(train: DataFrame, cols: list[str], label: str = "label") -> Score:
    """Mean over the columns of the training rate of the row's level (levels
    unknown or missing: the overall rate): a closed-form model of categories."""
    overall = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rates = (train.select(label, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([label], cols, "column", "level")
             .where("level IS NOT NULL").groupBy("column", "level").agg(F.avg(F.col(label).cast("double")).alias("rate")))
    rates = vocab.materialize(rates, "level-rates")

    def score(df: DataFrame, name: str) -> DataFrame:
        keep, j = df.columns, df
        for i, c in enumerate(cols):
            part = rates.where(F.col("column") == c).select(F.col("level").alias(f"_wl_l{i}"), F.col("rate").alias(f"_wl_r{i}"))
            j = j.join(part, F.col(f"`{c}`").cast("string") == F.col(f"_wl_l{i}"), "left").drop(f"_wl_l{i}")
        mean: Column = sum((F.coalesce(f"_wl_r{i}", F.lit(overall)) for i in range(len(cols))), F.lit(0.0)) / F.lit(float(len(cols)))
        return j.select(*[F.col(f"`{c}`") for c in keep], mean.alias(name))
    return score


def linear_rates(train: DataFrame, cols: list[str], label: str = "label") -> Score:
    """The training rate plus the mean of the columns' univariate least-squares
    changes, kept inside (0, 1): a closed-form model of numbers."""
    overall = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    coefs = explain.linear_coefficients(train, cols, label).collect()

    def score(df: DataFrame, name: str) -> DataFrame:
        change = sum((F.lit(r["weight"] or 0.0) * (F.col(f"`{r['feature']}`").cast("double") - F.lit(r["mean"] or 0.0)) for r in coefs), F.lit(0.0))
        return df.withColumn(name, F.least(F.greatest(F.lit(overall) + change / F.lit(float(len(coefs))), F.lit(0.0)), F.lit(1.0)))
    return score


def vector_model(train: DataFrame, cols: list[str], estimator, categorical: bool, label: str = "label", key: str = "encounter_id",
                 balance: str = "none", seed: int = 42) -> Score:
    """A ``pyspark.ml`` classifier on the one-hot (or plain) columns, balanced on
    the training rows."""
    enc = vocab.fit_encoder(train, cols if categorical else [], [] if categorical else cols)
    model = models.fit_balanced(enc.vectors(train, [key, label]), estimator, balance, label, key, seed)

    def score(df: DataFrame, name: str) -> DataFrame:
        v = model.transform(enc.vectors(df, df.columns, "_wl_features")
                            .withColumnRenamed("_wl_features", model.getFeaturesCol()))
        return v.select(*[F.col(f"`{c}`") for c in df.columns], vector_to_array("probability")[1].alias(name))
    return score
