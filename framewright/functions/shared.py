"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that ``spark.checkpoint.dir`` names; in a local one only where all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        found = f"file://{tempfile.mkdtemp(prefix='framewright-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
