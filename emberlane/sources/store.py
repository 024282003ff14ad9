"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application.
_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the folder that ``spark.checkpoint.dir`` names, of a temporary one where it is
    unset (tests). It goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="emberlane-")
        _folders[app] = f"{root.rstrip('/')}/emberlane/{app}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(_folders[app])
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written and read again: computed once, a short plan for what iterates over it, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
