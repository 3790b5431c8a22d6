"""Session helpers: settings every query relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build(cores: int | str = "*", shuffle_partitions: int = 32, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Times are UTC epoch milliseconds, so zone-dependent casts must run under UTC."""
    # Joins on (pool, block, index) may run on data already partitioned by (pool, block).
    for name, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.requireAllClusterKeysForCoPartition", "false")):
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def reuse(df: DataFrame) -> DataFrame:
    """Keep a table several branches of one plan read. Lost parts are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A session in one process may do without: it gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a table in the shared folder; survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
