"""Sinks: ranked CSV export, key/value reports, model persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_top_csv(df: DataFrame, path: str, k: int = 60, by: str = "importance",
                  tie: str = "feature") -> None:
    """Top-k rows by ``by`` (descending, unique tie-break) as one CSV with header."""
    (df.orderBy(F.desc(by), F.asc(tie)).limit(k).coalesce(1)
       .write.mode("overwrite").option("header", True).csv(path))


def report_frame(spark, items: dict) -> DataFrame:
    """A (key, value) frame from a small dict of results."""
    return spark.createDataFrame([(str(k), str(v)) for k, v in items.items()],
                                 "key string, value string")


def write_report(df: DataFrame, path: str) -> None:
    """(key, value) rows written as ``key: value`` text lines."""
    (df.select(F.concat_ws(": ", "key", "value").alias("value")).coalesce(1)
       .write.mode("overwrite").text(path))


def save_model(model, path: str) -> None:
    """Persist a fitted pyspark.ml model or pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str, fallback=None):
    """Load a saved PipelineModel.  Only if nothing is saved at ``path`` is
    ``fallback`` (the in-session model) returned; a broken model raises."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if fallback is not None and spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return fallback
    return PipelineModel.load(path)
