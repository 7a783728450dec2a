"""Named versions of a whole dataset, so that a step can be undone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def snapshot(tables: Mapping[str, DataFrame], root: str, tag: str) -> dict[str, str]:
    """Write every table under root/tag and return where each one went."""
    paths = {name: f"{root}/{tag}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def restore(spark: SparkSession, root: str, tag: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{tag}/{name}") for name in names}


def discard(spark: SparkSession, root: str, tag: str) -> bool:
    """Delete one version through Hadoop's file system, wherever the folder lives."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{tag}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
