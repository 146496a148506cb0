"""The folder for tables that all executors reach."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_TEMPORARY: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, that driver and executors share. Where none is named, one machine uses a temporary folder, and a cluster raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _TEMPORARY:
        _TEMPORARY.append(tempfile.TemporaryDirectory(prefix="tessera-"))
    return f"file://{_TEMPORARY[0].name}"
