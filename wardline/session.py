"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "wardline",
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on and the UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, local_default: bool = False) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the cluster (shared storage).  Only
    when the setting is unset and the master is ``local[...]`` (tests, local
    runs; ``local_default=True``) is a local folder created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        spark.sparkContext.setCheckpointDir(d)
        return d
    if not (local_default and spark.sparkContext.master.split("[")[0] == "local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    d = tempfile.mkdtemp(prefix="wardline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df, label: str = "table"):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: one computation, a cut lineage, and data that outlives any
    executor (unlike cached blocks)."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark, local_default=True).rstrip('/')}/wardline-tables/" \
           f"{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Tables of fewer rows stay as they lie: there is little to gain.
FEW_ROWS = 1 << 16


def spread(table):
    """``table``, as read from files, over all cores; as it is if it is small or
    has that many partitions already.  Files are split by their size on disk,
    which says little about the work on a row."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores or table.count() < FEW_ROWS:
        return table
    return table.repartition(cores)
