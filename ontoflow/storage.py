"""Storage that driver and executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of this machine only in local mode without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ontoflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back; survives the executors that made it."""
    path = posixpath.join(shared_root(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
