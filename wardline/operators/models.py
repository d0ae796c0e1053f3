"""Classifiers from pyspark.ml, balance-then-fit, and score frames.

Models train on a (key, label, features) frame.  Balancing happens only on
the training side (``fit_balanced``); prediction never resamples.
"""

from __future__ import annotations

import math
import threading

from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import network, sample, trees


def logistic(n_train: int | None = None, max_iter: int = 1000, weight_col: str | None = None,
             features: str = "features", label: str = "label") -> LogisticRegression:
    """L2 logistic regression.  The common C=1 convention (penalty on the
    summed loss) equals ``regParam = 1 / n_train`` on Spark's averaged loss."""
    reg = 1.0 / n_train if n_train else 0.0
    lr = LogisticRegression(maxIter=max_iter, regParam=reg, elasticNetParam=0.0,
                            standardization=False, featuresCol=features, labelCol=label)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def forest(num_trees: int = 100, max_depth: int = 10, min_leaf: int = 1,
           subset: str = "sqrt", bootstrap: bool = True, seed: int = 42,
           weight_col: str | None = None, features: str = "features",
           label: str = "label") -> RandomForestClassifier:
    if max_depth > 30:
        raise ValueError("Spark's trees are at most 30 deep")
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=min_leaf, featureSubsetStrategy=subset,
                                bootstrap=bootstrap, seed=seed, featuresCol=features,
                                labelCol=label)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def gbt(max_iter: int = 100, max_depth: int = 6, step: float = 0.1, subsample: float = 1.0,
        colsample: float | str = "all", seed: int = 42, weight_col: str | None = None,
        features: str = "features", label: str = "label") -> GBTClassifier:
    """Gradient-boosted trees; ``colsample`` is a fraction of features per tree node
    split ('all' = every feature)."""
    g = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                      subsamplingRate=subsample, featureSubsetStrategy=str(colsample),
                      seed=seed, featuresCol=features, labelCol=label)
    if weight_col:
        g.setWeightCol(weight_col)
    return g


def mlp(n_features: int, hidden: tuple[int, ...] = (128, 64, 32), max_iter: int = 100,
        block_size: int = 1024, step: float = 0.03, seed: int = 42,
        features: str = "features", label: str = "label") -> MultilayerPerceptronClassifier:
    """Feed-forward network (sigmoid hidden layers, softmax output, 2 classes)."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=max_iter,
                                          blockSize=block_size, stepSize=step, seed=seed,
                                          featuresCol=features, labelCol=label)


def balanced(train: DataFrame, balance: str = "none", label: str = "label", key: str = "key", seed: int = 42) -> DataFrame:
    """The training rows as ``balance`` wants them:

    'none'; 'resample' (random oversampling that keeps the original rows) and
    'replace' (the minority replaced by draws), both as multiplicities in a
    ``weight`` column, so the balanced copy is never written; 'smote' (synthetic
    minority rows, written once as a table); 'weights' (balanced class weights
    in ``weight``)."""
    if balance == "none":
        return train
    if balance in ("resample", "replace"):
        counted = sample.oversample_counts(train, label, key, seed, balance == "resample", "weight")
        return counted.where("weight > 0").withColumn("weight", F.col("weight").cast("double"))
    if balance == "smote":
        from wardline.operators.neighbors import smote
        from wardline.operators.vocab import read_vectors
        dense = train.select(key, label, vector_to_array("features").alias("features"))
        x = F.filter(F.transform("features", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0.0)
        # a drawn row has the features of its two neighbours, not all
        rows = smote(dense, label, key, "features", seed=seed).withColumn("_wl_e", x).withColumn("features", F.struct(
            F.lit(0).cast("byte").alias("type"), F.size("features").alias("size"),
            F.transform("_wl_e", lambda e: e["i"]).alias("indices"), F.transform("_wl_e", lambda e: e["v"]).alias("values")))
        return read_vectors(rows.drop("_wl_e"), "features", "train-smote")
    if balance == "weights":
        return sample.with_class_weights(train, label, "weight")
    raise ValueError(f"unknown balance {balance!r}")


#: Cells (rows times features) of a training partition at most: 128 MB as Spark's
#: trees hold them, 4 bytes a cell.  Below the second number rows stay as they lie.
PART_CELLS, FEW_CELLS = 1 << 25, 1 << 24
#: Rows of a partition of blocks at most; they are read one block at a time.
PART_ROWS = 1 << 20
#: The same for logistic regression, which keeps sparse rows.
LINEAR_ROWS = 1 << 18


def _shape(rows: DataFrame, features: str = "features") -> tuple[int, int]:
    """Number of rows, and of features."""
    first = rows.select(features).head()
    return (rows.count(), first[0].size) if first else (0, 0)


def dealt(train: DataFrame, like: DataFrame | None = None, key: str | None = None, features: str = "features") -> DataFrame:
    """``train`` in partitions of bounded size, a multiple of the cores.

    Fits read the rows many times, from memory and as dense rows, while a table
    of sparse vectors is read back by its size on disk: a few tasks, a hundred
    times larger in memory.  ``like`` is a table with the rows and vectors that
    are counted (default: ``train``).  With ``key`` rows are dealt by it and
    sorted, so a fit sees them in one order in every run.  What a fit draws by partition
    (bags, the sample behind split points) is drawn from these."""
    cells = math.prod(_shape(train if like is None else like, features))
    return train if cells < FEW_CELLS else _deal(train, cells / PART_CELLS, key, features)


def _deal(train: DataFrame, least: float, key: str | None, features: str) -> DataFrame:
    """``train`` in ``least`` partitions or more, a multiple of the cores."""
    cores = max(train.sparkSession.sparkContext.defaultParallelism, 1)
    parts = cores * math.ceil(least / cores)
    if key is None:
        return train.repartition(parts)
    # rows without a key differ in their features
    return train.repartition(parts, key, features).sortWithinPartitions(key)


def _is_net(estimator) -> bool:
    """Whether :mod:`network` fits it."""
    return isinstance(estimator, MultilayerPerceptronClassifier) and estimator.getSolver() == "l-bfgs"


def fit(estimator, train: DataFrame, weight: str = "weight"):
    """Fit with the ``weight`` column of ``train``, if it has one.  An estimator
    without weights gets each row as often as its weight says, so it takes
    multiplicities, but no class weights.  Networks are fitted by
    :mod:`network`, which counts a row so often and does not copy it."""
    net = _is_net(estimator)
    if weight not in train.columns:
        return network.fit(estimator, train) if net else estimator.fit(train)
    if hasattr(estimator, "hasParam") and estimator.hasParam("weightCol"):
        return estimator.copy({estimator.getParam("weightCol"): weight}).fit(train)
    if train.where(F.col(weight) != F.floor(weight)).limit(1).count():
        raise ValueError("the estimator takes no weights; balance it by 'resample', 'replace' or 'smote'")
    return network.fit(estimator, train, weight) if net else estimator.fit(sample.expand(train, weight))


class Training:
    """Rows that one or more estimators are fitted to: :func:`dealt`, then
    :func:`fit` for each.  From ``FEW_CELLS`` on trees are fitted by
    :mod:`trees`, to blocks that are made once for all of them; blocks of
    trees and networks are small, so a partition has many rows.  A context."""

    def __init__(self, train: DataFrame, like: DataFrame | None = None, key: str | None = None):
        self.train, self.like, self.key = train, train if like is None else like, key
        self.shape, self.packed, self.lock = _shape(self.like), None, threading.Lock()

    def blocks(self, estimator) -> trees.Packed | None:
        """The blocks, if ``estimator`` can be fitted to them."""
        rows, size = self.shape
        if rows * size < FEW_CELLS or not trees.takes(estimator) or (estimator.getLabelCol(), estimator.getFeaturesCol()) != ("label", "features"):
            return None
        with self.lock:
            if self.packed is None:
                dealt_rows = _deal(self.train, rows / PART_ROWS, self.key, "features")
                self.packed = trees.Packed(dealt_rows, size, weight="weight" if "weight" in self.train.columns else None)
        return self.packed if self.packed.fits else None

    def fit(self, estimator):
        blocks = self.blocks(estimator)
        if blocks:
            return trees.fit(estimator, blocks)
        rows, size = self.shape
        # neither makes rows dense, nor draws by partition
        per = PART_ROWS if _is_net(estimator) else LINEAR_ROWS if isinstance(estimator, LogisticRegression) else 0
        if per and rows * size >= FEW_CELLS:
            return fit(estimator, _deal(self.train, rows / per, self.key, "features"))
        return fit(estimator, dealt(self.train, self.like, self.key))

    def __enter__(self) -> Training:
        return self

    def __exit__(self, *_) -> None:
        if self.packed is not None:
            self.packed.__exit__()


def fit_balanced(train: DataFrame, estimator, balance: str = "none", label: str = "label",
                 key: str = "key", seed: int = 42):
    """Resample-then-fit: :func:`balanced`, then the fit of :class:`Training`."""
    rows = balanced(train, balance, label, key, seed)
    with Training(rows, rows if balance == "smote" else train, key) as training:
        return training.fit(estimator)


def score(model, df: DataFrame, key: str = "key", label: str = "label",
          threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Score frame (key, label, p, pred): p = probability of class 1, pred = p > threshold."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability")).getItem(1)
    return out.select(key, label, *(keep or []), p.alias("p"),
                      (p > F.lit(threshold)).cast("int").alias("pred"))
