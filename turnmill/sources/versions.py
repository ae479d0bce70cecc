"""Tables in whole versions: readers always find one that is complete.

A version is a folder below <path>/versions. When it is written, an empty file of its number is made
below <path>/published, and that is all that makes it the one to read: a marker is there or not, on
any file system. A run that dies before that leaves the version before it published.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def hadoop_path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path, as Spark itself sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_path(spark, path)
    fs.mkdirs(where)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)


def published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, in order."""
    fs, where = hadoop_path(spark, f"{path}/published")
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where))


def mark_published(spark: SparkSession, path: str, version: int) -> None:
    fs, where = hadoop_path(spark, f"{path}/published/{version}")
    fs.create(where, True).close()


def version_path(path: str, version: int) -> str:
    return f"{path}/versions/{version}"


def publish(df: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """Write df as a version and publish it; a version that is published already stays as it is.

    The ``keep`` newest versions stay, so that a reader of the one before can finish.
    """
    spark = df.sparkSession
    if version in published(spark, path):
        return
    df.write.mode("overwrite").parquet(version_path(path, version))
    mark_published(spark, path, version)
    for old in published(spark, path)[:-keep]:
        for name in (f"{path}/published/{old}", version_path(path, old)):
            delete_folder(spark, name)


def read_version(
    spark: SparkSession, path: str, schema: str | T.StructType, below: int | None = None
) -> DataFrame:
    """The newest published version, or the newest ``below`` a number; no rows if there is none."""
    found = [v for v in published(spark, path) if below is None or v < below]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(version_path(path, found[-1]))
