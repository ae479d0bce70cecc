"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that suit the operators on a cluster as well as on one machine.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # For the code page of annotated tables.
    "spark.sql.legacy.javaCharsets": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or by SparkContext.setCheckpointDir.

    All executors must reach it. There is no other place to fall back to.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors reach.")
    return named


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written in the shared folder: lineage ends there."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
