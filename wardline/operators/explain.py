"""Attribution: exact Shapley values of linear models, permutation
importance, and sampled-permutation Shapley values for any model.

Model-agnostic methods multiply rows (rows x features x repeats); they run
on a bounded sample (``sample.sample_n``), explode the work as rows and score
it with one distributed ``transform`` – no driver loop per feature.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.hashing import hash_int, seeded_hash
from wardline.operators import metrics, models
from wardline.operators.order import rank_within, scan_before
from wardline.session import materialize

Scorer = Callable[[DataFrame], DataFrame]   # adds a probability column "p"


def linear_coefficients(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, weight, mean): univariate least-squares slopes of the label on
    each feature, a closed-form linear scorer (one aggregate pass)."""
    aggs = []
    for c in features:
        aggs += [F.regr_slope(F.col(label).cast("double"), F.col(c).cast("double")).alias(f"w__{c}"),
                 F.avg(F.col(c).cast("double")).alias(f"m__{c}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `w__{c}`, `m__{c}`" for c in features)
    return one.select(F.expr(f"stack({len(features)}, {stack}) as (feature, weight, mean)"))


def shapley_linear(df: DataFrame, coefs: DataFrame, key: str, prefix: str = "phi_") -> DataFrame:
    """Exact Shapley values of a linear model with independent features:
    phi_j = w_j * (x_j - mean_j), mean over the background the means were
    fitted on.  ``coefs`` is (feature, weight, mean), one row per feature."""
    rows = coefs.collect()
    cols = [(F.coalesce(F.lit(r["weight"]), F.lit(0.0)) *
             (F.col(f"`{r['feature']}`").cast("double") - F.lit(r["mean"])))
            .alias(prefix + r["feature"]) for r in rows]
    return df.select(key, *cols)


def to_long(wide: DataFrame, key: str, prefix: str = "phi_") -> DataFrame:
    """(key, feature, value) from prefixed wide columns."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot([key], cols, "feature", "value").withColumn(
        "feature", F.expr(f"substring(feature, {len(prefix) + 1})"))


#: Multipliers of the donor bijection stay below this, so that a multiplier times
#: a position fits a BIGINT up to 2^43 rows.
MULTIPLIERS = 1 << 20


def donor_keys(features: list[str], n_repeats: int, n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(feature, repeat, a, b) of every copy: the row at position x gets its value
    from position (a * x + b) mod n.  ``a`` has no factor in common with n, so
    each row gives its value exactly once; both come from md5 of the copy."""
    out = []
    for f in features:
        for r in range(n_repeats):
            h = hashlib.md5(f"{seed}:perm:{f}:{r}".encode()).hexdigest()
            a = int(h[:15], 16) % min(MULTIPLIERS, max(n, 2)) + 1
            while math.gcd(a, n) != 1:
                a = a % min(MULTIPLIERS, max(n, 2)) + 1
            out.append((f, r, a, int(h[15:30], 16) % max(n, 1)))
    return out


def _times(a: int, x: Column, n: int) -> Column:
    """(a * x) mod n for 0 <= a, x < n, without leaving BIGINT up to 2^41 rows."""
    high, low = divmod(a, MULTIPLIERS)
    return F.pmod(F.pmod(F.lit(high) * x, F.lit(n)) * F.lit(MULTIPLIERS) + F.lit(low) * x, F.lit(n))


def permuted(df: DataFrame, features: list[str], key: str, n_repeats: int, seed: int = 42) -> DataFrame:
    """All copies of ``df`` for permutation importance: (_wl_f, _wl_r) and the
    columns of ``df``, with the column named by ``_wl_f`` taken from the row's
    donor.  ``features`` are numeric columns.

    Rows get a position in a seeded order once.  The row at position y gives its
    value to the position x with (a * x + b) mod n = y, which is arithmetic too,
    so each value moves once, as (position, copy, value), to the row that is
    copied with it.  That join is by sort: the table's size on disk says little
    about its rows in memory, so neither side may be broadcast by it."""
    h0 = "_wl_h0"
    base = rank_within(df.withColumn(h0, seeded_hash(seed, key)), [], [h0, key], F.substring(h0, 1, 4), "_wl_pos").drop(h0)
    base = materialize(base.withColumn("_wl_pos", F.col("_wl_pos") - 1), "positions")
    n = base.count()
    keys = donor_keys(features, n_repeats, n, seed)
    gives = F.array(*[F.struct(_times(pow(a, -1, n) if n > 1 else 0, F.pmod(F.col("_wl_pos") - F.lit(b), F.lit(n)), max(n, 1)).alias("pos"),
                               F.lit(i).alias("copy"), F.col(f"`{f}`").cast("double").alias("v")) for i, (f, _, a, b) in enumerate(keys)])
    sent = base.select(F.explode(gives).alias("x")).select(F.col("x.pos").alias("_wl_to"), F.col("x.copy").alias("_wl_c"), F.col("x.v").alias("_wl_v"))
    whole = sent.join(base.hint("merge"), F.col("_wl_to") == F.col("_wl_pos"))
    types = dict(df.dtypes)
    name = F.array(*[F.lit(f) for f, _, _, _ in keys])[F.col("_wl_c")]
    new = {c: F.when(F.col("_wl_f") == c, F.col("_wl_v").cast(types[c])).otherwise(F.col(f"`{c}`")) for c in features}
    whole = whole.withColumns({"_wl_f": name, "_wl_r": F.array(*[F.lit(r) for _, r, _, _ in keys])[F.col("_wl_c")]})
    return whole.select("_wl_f", "_wl_r", *[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def _scored(df: DataFrame, score: str, label: str, threshold: float, group: list[str]) -> DataFrame:
    """(group..., s): one score of (label, p), the higher the better."""
    if score == "accuracy":
        hit = ((F.col("p") > threshold).cast("int") == F.col(label)).cast("double")
        return df.groupBy(*group).agg(F.avg(hit).alias("s"))
    if score == "log_loss":
        return metrics.log_loss(df, label, "p", group).select(*group, (-F.col("log_loss")).alias("s"))
    if score == "auc":
        return metrics.roc_auc(df, label, "p", group).select(*group, F.col("auc").alias("s"))
    raise ValueError(f"unknown score {score!r}")


def permutation_importance(df: DataFrame, features: list[str], scorer: Scorer,
                           key: str, label: str = "label", n_repeats: int = 10,
                           seed: int = 42, threshold: float = 0.5, score: str = "accuracy") -> DataFrame:
    """(feature, importance_mean, importance_std): drop in ``score`` ('accuracy',
    'log_loss' or 'auc') when one feature's values are shuffled across rows, over
    ``n_repeats`` seeded shuffles (:func:`permuted`), all scored in one pass.

    ``features`` may be 0/1 columns of a one-hot frame whose scorer turns them
    back into levels first (``encode.inverse_one_hot``)."""
    base = _scored(scorer(df), score, label, threshold, []).first()["s"]
    got = scorer(permuted(df, features, key, n_repeats, seed)).select("_wl_f", "_wl_r", label, "p")
    copy = ["_wl_f", "_wl_r"]
    if score == "auc":  # read by both levels of the scan: not the copies, their distinct scores
        per = metrics.auc_of_scores(materialize(metrics.per_score(got, label, "p", copy), "permuted-scores"), copy)
        per = per.select(*copy, F.col("auc").alias("s"))
    else:
        per = _scored(got, score, label, threshold, copy)
    return (per.groupBy(F.col("_wl_f").alias("feature"))
               .agg(F.avg(F.lit(base) - F.col("s")).alias("importance_mean"),
                    F.stddev_pop(F.lit(base) - F.col("s")).alias("importance_std")))


def draw_weighted(background: DataFrame, key: str, weight: str, n: int) -> tuple[DataFrame, int, int]:
    """(rows, total weight, bucket width); the rows are ``background`` with ``_wl_lo`` and ``_wl_at``: row i is the one drawn for
    every u in [_wl_lo, _wl_lo + weight), and once per bucket of width
    ceil(total / n) that this range meets (inverse of the cumulative weights, so
    heavier rows have more buckets, about two per row on average)."""
    total = background.agg(F.sum(weight)).first()[0] or 0
    width = max(1, -(-int(total) // max(n, 1)))
    low = scan_before(background.where(F.col(weight) > 0), [], [key], {"_wl_lo": F.col(weight).cast("long")})
    last = F.floor((F.col("_wl_lo") + F.col(weight) - 1) / width)
    return low.withColumn("_wl_at", F.explode(F.sequence(F.floor(F.col("_wl_lo") / width), last))), int(total), width


def shapley_sampled(explain: DataFrame, background: DataFrame, features: list[str],
                    scorer: Scorer, key: str, n_perm: int = 8, seed: int = 42,
                    weight: str | None = None, keep_base: bool = False) -> DataFrame:
    """(key, feature, phi[, base, full]): sampled-permutation Shapley values.

    For each explained row and each of ``n_perm`` seeded feature orders, a
    background row is drawn, uniformly or by its integer ``weight`` (centroids
    with sizes); features switch from background to the row one at a time in
    that order and each switch's change in ``p`` is that feature's marginal
    contribution.  Per row, the values sum to ``full``, its p, minus ``base``, the
    mean p of its drawn background rows."""
    m = len(features)
    bgk = "_wl_bk"
    cols = [F.col(f"`{c}`") for c in features]
    bg = background.select(F.col(key).alias(bgk), *cols, (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_wl_w"))
    bg = materialize(bg, "background")
    ranges, total, width = draw_weighted(bg, bgk, "_wl_w", bg.count())
    if not total:
        raise ValueError("the background has no rows")
    z = ranges.select("_wl_at", "_wl_lo", (F.col("_wl_lo") + F.col("_wl_w")).alias("_wl_hi"), F.struct(*cols).alias("_wl_z"))
    ex = explain.select(key, *cols).withColumn("_wl_j", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    u = F.pmod(hash_int(seeded_hash(seed, F.lit("pick"), F.col(key), F.col("_wl_j"))), F.lit(total))
    ex = ex.withColumn("_wl_u", u).withColumn("_wl_at", F.floor(F.col("_wl_u") / width))
    ex = ex.join(z, "_wl_at").where((F.col("_wl_lo") <= F.col("_wl_u")) & (F.col("_wl_u") < F.col("_wl_hi")))
    order = F.array_sort(F.array(*[F.struct(seeded_hash(seed, F.lit("ord"), F.col(key),
                                                        F.col("_wl_j"), F.lit(c)).alias("h"),
                                            F.lit(c).alias("f")) for c in features]))
    ex = ex.withColumn("_wl_ord", F.transform(order, lambda s: s["f"]))
    steps = ex.withColumn("_wl_s", F.explode(F.sequence(F.lit(0), F.lit(m))))
    # a feature takes the row's value once its position in the order is < step
    mixed = steps.withColumns({
        c: F.when(F.array_position("_wl_ord", F.lit(c)) <= F.col("_wl_s"), F.col(f"`{c}`"))
            .otherwise(F.col(f"_wl_z.`{c}`")) for c in features})
    scored = scorer(mixed.drop("_wl_z"))
    # the steps of one row and order: features + 1 numbers
    walk = scored.select(key, "_wl_j", "_wl_ord", F.struct("_wl_s", "p").alias("x")).groupBy(key, "_wl_j", "_wl_ord").agg(
        F.array_sort(F.collect_list("x")).alias("x"))
    marg = walk.select(key, F.posexplode("_wl_ord").alias("i", "feature"), "x").select(
        key, "feature", (F.col("x")[F.col("i") + 1]["p"] - F.col("x")[F.col("i")]["p"]).alias("d"),
        F.col("x")[0]["p"].alias("z"), F.element_at("x", -1)["p"].alias("y"))
    out = marg.groupBy(key, "feature").agg(F.avg("d").alias("phi"), F.avg("z").alias("base"), F.avg("y").alias("full"))
    return out if keep_base else out.drop("base", "full")


def kmeans_summary(df: DataFrame, k: int = 100, features: str = "features",
                   seed: int = 42) -> DataFrame:
    """Weighted background summary: (cluster, size, centroid) of k-means; at
    most k rows, fewer if there are fewer distinct points."""
    from pyspark.ml.clustering import KMeans
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(models.dealt(df, features=features))
    sizes = model.transform(df).groupBy("cluster").agg(F.count(F.lit(1)).cast("long").alias("size"))
    spark = df.sparkSession
    cents = spark.createDataFrame([(i, [float(x) for x in c])
                                   for i, c in enumerate(model.clusterCenters())],
                                  "cluster int, centroid array<double>")
    return cents.join(sizes, "cluster", "left").fillna(0, subset=["size"])


def centroid_background(summary: DataFrame, features: list[str], key: str) -> DataFrame:
    """The centroids of :func:`kmeans_summary` as background rows: ``key`` (the
    cluster), the feature columns and ``size``, their weight."""
    return summary.select(F.col("cluster").cast("long").alias(key), "size",
                          *[F.col("centroid")[i].alias(c) for i, c in enumerate(features)])
