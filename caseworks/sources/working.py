"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, a local one serves a local master, and a cluster is an error."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or os.path.join(tempfile.gettempdir(), "caseworks-shared")).rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back: later steps neither recompute it nor depend on the executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, label: str, source: str, make) -> DataFrame:
    """The table that make() gives, written once for each application and source."""
    key = (spark.sparkContext.applicationId, label, source)
    if key not in _kept:
        _kept[key] = settle(make(), label)
    return _kept[key]
