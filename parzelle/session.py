"""Session settings the jobs are written for."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE does three jobs here: it coalesces small shuffle partitions, turns joins
# with a small side into broadcast joins after measuring them, and splits skewed
# partitions of the equi joins. The thresholds are lower than the defaults because
# a cadastral row is narrow and the work per row (geometry) is high.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app_name: str = "parzelle") -> SparkSession.Builder:
    """A session builder with the settings above; the caller sets the master."""
    made = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="parzelle-")


def shared_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh path under the folder that all machines share.

    The folder is the one named by ``spark.checkpoint.dir``. Only a session without
    machines of its own (master ``local``) may leave it unset: then a temporary
    folder, made once a process, takes its place. On a cluster an unset
    folder is an error, as a machine-local one would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, prefix: str) -> DataFrame:
    """Write an intermediate result once and go on from the written table.

    This cuts the lineage, survives the loss of executors and, unlike a checkpoint,
    gives the planner the table's true size: small results are then broadcast after a
    check of their size, large ones are not.
    """
    spark = df.sparkSession
    path = shared_dir(spark, prefix)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
