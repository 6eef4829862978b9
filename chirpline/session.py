"""Session helpers: the shared folder and the settings the jobs are tuned for."""

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings worth having on a cluster. None of them is needed for right results.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else a folder of the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_chirpline"
    return path.rstrip("/")


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder name of the shared folder for one run."""
    return f"{shared_dir(spark)}/chirpline/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder. It is worked out once, and what a task of it decided stays so."""
    path = run_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there. The one place that goes past the DataFrame API."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_runs(spark: SparkSession) -> bool:
    """Delete the folders of all runs. For the caller, once nothing reads their results any more."""
    fs, target = file_system(spark, f"{shared_dir(spark)}/chirpline")
    return fs.delete(target, True)
