"""Session helpers: a local session for tests and benches, table loading, stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sievework")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a folder in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Later plans start from the table: the work is done once, a lost executor re-reads files
    instead of recomputing, and the planner knows the true size when it considers a broadcast."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sievework-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    stage.stage_path = path
    return stage


def release(*stages: DataFrame) -> None:
    """Delete stages that no later plan reads: those whose successors are written already."""
    for stage in stages:
        path = stage.sparkSession._jvm.org.apache.hadoop.fs.Path(stage.stage_path)
        path.getFileSystem(stage.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer input splits than cores one partition per core; larger scans, which
    already have more splits than that, are returned untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
