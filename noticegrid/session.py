"""Session settings the jobs expect, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffle partitions, turns a join into a broadcast join only once the
# side has been measured below the threshold, and splits skewed join partitions.
# Estimates are not trusted with a broadcast: cells, grams, pages and texts that are made from a key are a hundred times their table.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "8m",
    "spark.sql.parquet.filterPushdown": "true",
    # rank filters up to this k are applied in every task before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.ui.explainMode": "formatted",
    # rows handed to Python at a time: texts are long, and a worker has a few hundred MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # keyed state of any size, and the only store that has maps, lists and timers
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app_name: str = "noticegrid", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Only a local master, where every task runs on this machine, may go without one and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="noticegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{checkpoint_root(spark)}/stage/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the written copy.

    For results that several later steps read: they are computed once, a lost executor costs
    nothing that was written, and plans stay small. The caller drops all copies with `drop_staged`
    once the results built on them are written.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
