"""Quality classifier with hierarchical empirical Bayes over sites.

1. A logistic model on counts of the text gives each document a probability.
2. Grouped sums of these probabilities give each host, and each path below it,
   a beta posterior: a path shrinks toward its host, a host toward all
   documents.  How strongly is estimated from the spread of the group means
   (method of moments), so sparse sites stay near the prior above them.
3. A document's posterior odds are its own likelihood ratio times the odds of
   its path, in which its own probability is left out.

Sums combine before the shuffle, and only ids and numbers are joined back, so a
host with a third of all rows costs no more than others.  The model is fitted
on at most ``max_labelled`` labelled rows (smallest hash of the id); hosts,
paths and scores cover all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import free, materialize
from wardline.llm.quality_rules import Text

#: Rows that a Python worker gets at once.
BATCH = 1000
FEATURES = ("log_words", "symbols", "bars", "upper", "distinct", "repeated", "word_length", "long_words",
            "dup_lines", "digits", "bangs", "commas", "empty")


def features(text: str) -> list[float]:
    """Bounded shares and logarithms; all 0 but ``empty`` for a text without words."""
    t = Text(text)
    n = t.n_words
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    b = text.encode()
    digits = len(b) - len(b.translate(None, b"0123456789"))
    chars = t.word_chars()
    return [math.log(n) / 10, min(t.n_symbols() / n, 4.0), min(b.count(b"|") / n, 2.0), t.n_upper() / n,
            len(set(t.words)) / n, t.n_repeat_words() / n, min(chars / n, 40.0) / 10,
            sum(len(w) > 20 for w in t.words) / n, t.n_dup_lines() / max(t.n_lines(), 1), min(digits / chars, 1.0),
            min(b.count(b"!") / n, 2.0), min((b.count(b",") + b.count(b".")) / n, 2.0), 0.0]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 20_000,
        ridge: float = 0.1) -> dict:
    """Logistic weights from ``labels(doc_id, <label>)``; null ids or labels are
    ignored.  With one class only, or no label, every text gets the share of
    label 1 (1 without any label: nothing is rejected)."""
    picked = (labels.select("doc_id", F.col(f"`{label_col}`").cast("int").alias("y")).dropna()
              .groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # one row for each id, however often it is repeated

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = pd.DataFrame([features(t) for t in b["text"]], columns=FEATURES)
            yield x.assign(y=b["y"].to_numpy())

    xy = (texts.select("text", "y")
          .mapInPandas(rows, ", ".join(f"{c} double" for c in FEATURES) + ", y int").toPandas())  # bounded
    y = xy.pop("y").to_numpy(float) if len(xy) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        p = y.mean() if len(y) else 1.0
        return {"w": [0.0] * len(FEATURES), "b": 20.0 * (2 * p - 1), "base": float(p)}
    A = np.column_stack([xy.to_numpy(float), np.ones(len(y))])
    w, R = np.zeros(A.shape[1]), ridge * np.eye(A.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(A @ w, -30, 30)))
        step = np.linalg.solve(A.T @ (A * (p * (1 - p))[:, None]) + R, A.T @ (y - p) - R @ w)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return {"w": [float(x) for x in w[:-1]], "b": float(w[-1]), "base": float(y.mean())}


def evidence(docs: DataFrame, model: dict, host_col: str, path_col: str) -> DataFrame:
    """(doc_id, fingerprint, host, path, p): the model's probability of label 1."""
    w, b = np.array(model["w"]), model["b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            z = np.array([features(t) for t in d["text"]]).reshape(-1, len(w)) @ w + b
            d["p"] = np.round(1 / (1 + np.exp(-np.clip(z, -13, 13))), 9)
            yield d.drop(columns="text")

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                        F.col(f"`{host_col}`").cast("string").alias("host"),
                        F.col(f"`{path_col}`").cast("string").alias("path"))
    keyed = keyed.select("doc_id", F.xxhash64("text").alias("fingerprint"), "host", "path", "text")
    nullable = keyed.select(F.col("doc_id").cast("string").alias("doc_id"), "fingerprint", "host", "path", "text")
    out = nullable.mapInPandas(run, "doc_id string, fingerprint long, host string, path string, p double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _strength(groups: DataFrame, prior: str = "prior") -> float:
    """How many documents the prior above a group is worth: the beta strength
    that explains the spread of the group means around it; large if the groups
    do not differ by more than chance."""
    d = F.col("s") / F.col("n") - F.col(prior)
    m = F.col(prior) * (1 - F.col(prior))
    # E[n d^2] = m (1 + (n - 1) / (k + 1)) for a beta-binomial group mean; its upper part solves for k
    r = groups.agg(F.sum(F.col("n") * d * d - m).alias("over"), F.sum((F.col("n") - 1) * m).alias("most")).first()
    if not r["most"] or r["over"] is None or r["over"] <= 1e-9 * r["most"]:
        return 1e6
    return min(1e6, max(1.0, r["most"] / r["over"] - 1))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """(host, path, s, n, prior): sums per path and the host posterior above it;
    then the path strength and the overall mean.  Null is a host of its own."""
    paths = materialize(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(max(total["s"] / total["n"], 1e-4), 1 - 1e-4) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("prior", F.lit(mean))
    k = _strength(hosts)
    above = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("prior"))
    sites = paths.join(above, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return sites, _strength(sites), mean


def final_score(p, s, n, prior, k: float, base: float) -> tuple:
    """(site, score): the path's posterior without the document's own share, and
    the document's posterior, both rounded."""
    site = F.round((s - p + k * prior) / (n - 1 + k), 6)
    base = min(max(base, 1e-4), 1 - 1e-4)
    logit = lambda c: F.log(c / (1 - c))
    z = logit(p) - F.lit(math.log(base / (1 - base))) + logit(F.least(F.greatest(site, F.lit(1e-4)), F.lit(1 - 1e-4)))
    return site, F.round(1 / (1 + F.exp(-z)), 6)


def posterior(scored: DataFrame, base: float, threshold: float = 0.5) -> DataFrame:
    """(doc_id, fingerprint, p, site, score, kept) for every row of ``scored``."""
    sites, k, _ = site_posteriors(scored)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "s", "n", "prior")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    site, score = final_score(F.col("p"), F.col("s"), F.col("n"), F.col("prior"), k, base)
    return (joined.withColumns({"site": site, "score": score})
            .select("doc_id", "fingerprint", "p", "site", "score", (F.col("score") >= threshold).alias("kept")))


def quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang",
            threshold: float = 0.5, **fit_params) -> DataFrame:
    """Score every row of ``docs``; null texts count as empty.

    One row per input row; repeated rows are scored each."""
    model = fit(docs, labels, **fit_params)
    scored = materialize(evidence(docs, model, host_col, path_col), "evidence", BATCH)
    return posterior(scored, model["base"], threshold)


def good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` without the rows that :func:`quality` rejects, told by id and text."""
    verdict = quality(docs, labels, **params)
    i, f = free(docs, "_i", "_f")
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(i), F.col("fingerprint").alias(f)).distinct()
    on = (docs["doc_id"].cast("long").eqNullSafe(F.col(i))
          & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f)))
    return docs.join(gone, on, "left_anti")
