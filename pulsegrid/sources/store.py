"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all runs on this machine, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = set_.get() if set_.isDefined() else tempfile.mkdtemp(prefix="pulsegrid-")
        if set_.isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
