"""Evaluation over a score frame (key, label 0/1, p [, pred] [, group...]).

Every metric is one partially-aggregated pass, grouped by optional model /
subgroup columns; ROC-AUC (rank form) and precision-recall curves are exact,
by a two-level scan over distinct scores, never one global sort in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.order import _join_ns, scan_before
from wardline.session import materialize

EPS = 1e-15


def predict_at(df: DataFrame, threshold: float = 0.5, prob: str = "p",
               out: str = "pred") -> DataFrame:
    """Class from probability with a strict ``>`` (0.5 exactly -> 0)."""
    return df.withColumn(out, (F.col(prob) > F.lit(threshold)).cast("int"))


def _cells(label: str, pred: str):
    y, yh = F.col(label), F.col(pred)
    return [F.sum(((y == 1) & (yh == 1)).cast("long")).alias("tp"),
            F.sum(((y == 0) & (yh == 1)).cast("long")).alias("fp"),
            F.sum(((y == 1) & (yh == 0)).cast("long")).alias("fn"),
            F.sum(((y == 0) & (yh == 0)).cast("long")).alias("tn")]


def _ratio(num, den):
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred",
              group: list[str] | None = None) -> DataFrame:
    """Zero-filled 2x2 confusion matrix as rows (group..., actual, predicted, n)."""
    g = group or []
    agg = df.groupBy(*g).agg(*_cells(label, pred))
    return agg.select(*g, F.expr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)")) \
        .withColumn("actual", F.col("actual").cast("int")) \
        .withColumn("predicted", F.col("predicted").cast("int")) \
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                           group: list[str] | None = None) -> DataFrame:
    """(group..., n, tp, fp, fn, tn, accuracy, precision, recall, f1); an
    undefined precision/recall/F1 is 0, and so are all counts of no rows."""
    g = group or []
    a = df.groupBy(*g).agg(F.count(F.lit(1)).cast("long").alias("n"), *_cells(label, pred)).fillna(0, ["tp", "fp", "fn", "tn"])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return a.select(*g, "n", "tp", "fp", "fn", "tn",
                    _ratio(tp + tn, F.col("n")).alias("accuracy"),
                    _ratio(tp, tp + fp).alias("precision"),
                    _ratio(tp, tp + fn).alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def per_score(df: DataFrame, label: str, score: str, g: list[str]) -> DataFrame:
    """(group..., _s, pos, neg): one row per distinct score, counts of classes;
    rows without a score can't be ranked and are left out."""
    return df.where(F.col(score).isNotNull()).groupBy(*g, F.col(score).cast("double").alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "p",
            group: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(group..., auc): probability a random positive outscores a random
    negative, ties counting one half.  NULL when a class is absent, so also for
    no rows or no scores at all.  A row without a score is left out.

    Rows are first reduced to one per distinct score (partial aggregation),
    then each score needs the negatives strictly below it: a two-level scan,
    exact for any number of scores and groups."""
    g = group or []
    return auc_of_scores(per_score(df, label, score, g), g, partitions)


def auc_of_scores(per: DataFrame, g: list[str], partitions: int | None = None) -> DataFrame:
    """(group..., auc) from :func:`per_score`."""
    pre = scan_before(per, g, ["_s"], {"neg_before": F.col("neg")}, partitions)
    return (pre.groupBy(*g).agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        .select(*g, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                           F.col("_u") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc")))


def pr_curve(df: DataFrame, label: str = "label", score: str = "p", group: list[str] | None = None,
             beta: float = 1.0, partitions: int | None = None) -> DataFrame:
    """(group..., threshold, pos, tp, fp, fn, tn, precision, recall, fbeta): one
    row per distinct score, for the rule ``score >= threshold``; ``pos`` counts
    the positives of exactly this score.

    Cumulative counts in descending order of the scores come from the same
    two-level scan as the ROC-AUC; class totals are joined per group."""
    g = group or []
    per = materialize(per_score(df, label, score, g), "scores")
    down = scan_before(per.withColumn("_down", -F.col("_s")), g, ["_down"],
                       {"tp": F.col("pos"), "fp": F.col("neg")}, partitions)
    totals = per.groupBy(*g).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if g:
        j = _join_ns(down, totals, g, broadcast=False)
    else:  # two numbers
        j = down.withColumns({c: totals.select(c).scalar() for c in ("_p", "_n")})
    out = j.select(*g, F.col("_s").alias("threshold"), (F.col("tp") + F.col("pos")).alias("tp"),
                   (F.col("fp") + F.col("neg")).alias("fp"), "pos", "_p", "_n")
    tp, fp, b2 = F.col("tp"), F.col("fp"), beta * beta
    fn = F.col("_p") - tp
    return out.select(*g, "threshold", "pos", "tp", "fp", fn.alias("fn"), (F.col("_n") - fp).alias("tn"),
                      _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("_p")).alias("recall"),
                      _ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("fbeta"))


def best_threshold(curve: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., threshold, precision, recall, fbeta, average_precision): the
    point of the largest F-beta of a curve (the highest threshold among ties),
    and the area under its steps (0 without positives)."""
    g = group or []
    agg = curve.groupBy(*g).agg(
        F.max_by(F.struct("threshold", "precision", "recall", "fbeta"), F.struct("fbeta", "threshold")).alias("_b"),
        F.sum(F.col("pos") * F.col("precision")).alias("_a"), F.sum("pos").alias("_p"))
    return agg.select(*g, "_b.*", _ratio(F.col("_a"), F.col("_p")).alias("average_precision"))


def log_loss(df: DataFrame, label: str = "label", prob: str = "p",
             group: list[str] | None = None, eps: float = EPS) -> DataFrame:
    """(group..., log_loss): mean negative log-likelihood, p clipped to [eps, 1-eps]."""
    g = group or []
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(eps)), F.lit(1 - eps))
    ll = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return df.groupBy(*g).agg(F.avg(ll).alias("log_loss"))


def evaluate(df: DataFrame, label: str = "label", prob: str = "p", threshold: float = 0.5,
             group: list[str] | None = None) -> DataFrame:
    """Named-model evaluation: accuracy, precision, recall, F1 at ``threshold``
    plus ROC-AUC, per group (model, subgroup...)."""
    g = group or []
    m = classification_metrics(predict_at(df, threshold, prob, "_wl_pred"), label, "_wl_pred", g)
    a = roc_auc(df, label, prob, g)
    if g:
        return _join_ns(m, a, g, "left", broadcast=False)
    return m.withColumn("auc", a.select("auc").scalar())


def threshold_sweep(df: DataFrame, thresholds: list[float], label: str = "label",
                    prob: str = "p", group: list[str] | None = None,
                    beta: float = 1.0) -> DataFrame:
    """Operating points: for every threshold t the counts and metrics of the
    rule ``p > t`` (group..., threshold, tp, fp, fn, tn, precision, recall,
    f1, fbeta).

    Rows are counted per interval between consecutive thresholds (Bucketizer
    on -p gives left-open intervals, i.e. the strict ``>``), at most
    len(thresholds)+1 cells per group; cumulative sums over that tiny table
    give every threshold.  No row is replicated per threshold."""
    g = group or []
    ts_desc = sorted({float(t) for t in thresholds}, reverse=True)
    splits = [float("-inf")] + [-t for t in ts_desc] + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_wl_np", outputCol="_wl_b",
                   handleInvalid="keep").transform(
        df.withColumn("_wl_np", -F.col(prob).cast("double")))
    # interval i holds ts_desc[i] < p <= ts_desc[i-1]; p > ts_desc[j] iff i <= j
    cells = b.groupBy(*g, F.col("_wl_b").cast("int").alias("_wl_j")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    grid_arr = F.array(*[F.struct(F.lit(j).alias("_wl_j"), F.lit(t).alias("threshold"))
                         for j, t in enumerate(ts_desc)])
    totals = cells.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = totals.select(*g, "P", "N", F.inline(grid_arr))
    w = Window.partitionBy(*g).orderBy("_wl_j").rowsBetween(Window.unboundedPreceding, 0)
    j = _join_ns(grid, cells, [*g, "_wl_j"], "left", broadcast=False)
    cum = j.select(*g, "threshold", "P", "N",
                   F.sum(F.coalesce(F.col("pos"), F.lit(0))).over(w).cast("long").alias("tp"),
                   F.sum(F.coalesce(F.col("neg"), F.lit(0))).over(w).cast("long").alias("fp"))
    out = cum.select(*g, "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
                     (F.col("N") - F.col("fp")).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    b2 = beta * beta
    return out.select("*", _ratio(tp, tp + fp).alias("precision"),
                      _ratio(tp, tp + fn).alias("recall"),
                      _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                      _ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("fbeta"))


def soft_vote(a: DataFrame, b: DataFrame, key: str = "key", label: str = "label",
              wa: float = 0.7, wb: float = 0.3, prob: str = "p") -> DataFrame:
    """Weighted mean of two models' probabilities for the same rows."""
    j = a.select(key, label, F.col(prob).alias("_pa")).join(
        b.select(key, F.col(prob).alias("_pb")), key, "inner")
    return j.select(key, label, ((F.lit(wa) * F.col("_pa") + F.lit(wb) * F.col("_pb"))
                                 / F.lit(wa + wb)).alias(prob))


def cascade(a: DataFrame, b: DataFrame, t1: float, t2: float, key: str = "key",
            label: str = "label", prob: str = "p") -> DataFrame:
    """Two-stage rule: the first model flags (p1 > t1), the second confirms (p2 > t2)."""
    j = a.select(key, label, F.col(prob).alias("p1")).join(
        b.select(key, F.col(prob).alias("p2")), key, "inner")
    return j.withColumn("pred", ((F.col("p1") > t1) & (F.col("p2") > t2)).cast("int"))


def compare_models(scores: dict[str, DataFrame], label: str = "label", prob: str = "p",
                   threshold: float = 0.5) -> DataFrame:
    """Side-by-side evaluation: score frames unioned with a ``model`` column."""
    frames = [df.select(F.lit(name).alias("model"), label, prob) for name, df in scores.items()]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return evaluate(u, label, prob, threshold, ["model"])
