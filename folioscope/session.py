"""Session settings the operators are designed around."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(
    app: str = "folioscope",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Session with adaptive planning on. On a cluster leave ``master`` and
    ``shuffle_partitions`` unset so spark-submit and AQE decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder the cluster names; ``fallback`` is applied
    only where the session has none."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    chosen = named or fallback
    if chosen and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.fspath(chosen))
    return chosen


def settle(df: DataFrame) -> DataFrame:
    """Compute a table that several later steps read once, as Parquet in the
    folder that ``spark.checkpoint.dir`` names, or in the warehouse where the
    session names none: both are shared. A lost executor then re-reads files
    instead of the whole chain before it, plans stay short and later steps read
    only their columns. The folder is the run's own and goes with it."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
