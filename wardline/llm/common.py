"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local folder is made only for a ``local[...]`` session that names none
    (tests, laptops)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        d = tempfile.mkdtemp(prefix="wardline-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Shuffle files of the write go as soon as it ends, so the steps of an
    operator don't add up on the executors' disks.  With ``batch``, Python
    workers get so many rows at once (Spark's own setting is 10,000)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    before = {RELEASE: spark.conf.get(RELEASE, "false")}
    spark.conf.set(RELEASE, "true")
    if batch:
        before[BATCH] = spark.conf.get(BATCH, "10000")
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty); other columns, whatever
    their names, never reach an operator."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def per_text(df: DataFrame, fn: Callable[[str], tuple], schema: str,
             make: Callable[[], Callable[[str], tuple]] | None = None) -> DataFrame:
    """One row per document: its id and what ``fn(text)`` returns.

    Texts stream through Arrow batches and nothing is kept between rows.
    ``make`` builds ``fn`` once in each task instead (automata, models)."""
    names = ["doc_id", *[c.strip().rsplit(" ", 1)[0].strip("`") for c in _split(schema)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make() if make else fn
        for b in batches:
            rows = [f(t) for t in b["text"]]
            out = dict(zip(names[1:], zip(*rows))) if rows else {n: [] for n in names[1:]}
            yield pd.DataFrame({"doc_id": b["doc_id"],
                                **{k: pd.Series(v, dtype=object, index=b.index) for k, v in out.items()}},
                               columns=names)

    # the id travels as text: pandas would make a nullable long a float
    return (df.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, f"doc_id string, {schema}")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def _split(schema: str) -> list[str]:
    depth, parts = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts
