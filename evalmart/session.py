"""Session settings and the checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "evalmart") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for an unset local master."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can read")
    return tempfile.mkdtemp(prefix="evalmart-checkpoint-")


def spread(df: DataFrame) -> DataFrame:
    """Input with fewer partitions than the session has cores is dealt out before costly work on its texts.

    One large row group cannot be split by the scan. A read of many files comes back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before costly work on each, whatever the number of splits: a file has as many busy ones as row groups.

    The number of partitions is given, so that adaptive execution does not gather rows that are few in bytes. Name the columns first.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes read the same rows in the same partitions."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table below the checkpoint folder: computed once, the same for every later pass, short lineage."""
    path = f"{checkpoint_dir(df.sparkSession)}/evalmart-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
