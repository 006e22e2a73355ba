"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where none is set and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        spark.sparkContext.setCheckpointDir(found := tempfile.mkdtemp(prefix="framewright-"))
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes a table that no later step reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_but(self, *kept: str) -> None:
        """Drops all tables but those named."""
        for name in dict.fromkeys(self.names):
            if name not in kept:
                self.drop(name)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: nothing is left to drop through it
            if name:
                raise

