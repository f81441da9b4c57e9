"""Folders named by a key, as Spark's partitioned writers leave them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def labels_below(spark: SparkSession, folder: str, key: str) -> list[str]:
    """The labels of the folders ``key=<label>`` right below ``folder``, ascending; one listing."""
    place, files = _files(spark, folder)
    if not files.exists(place):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(place)]
    return sorted(name.removeprefix(f"{key}=") for name in names if name.startswith(f"{key}="))


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether Spark's writer has committed ``folder``."""
    place, files = _files(spark, f"{folder}/_SUCCESS")
    return files.exists(place)


def remove_folder(spark: SparkSession, folder: str) -> None:
    place, files = _files(spark, folder)
    files.delete(place, True)
