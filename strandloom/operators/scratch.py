"""Tables that a step writes and a later one reads, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a session in one process may name none; its folder goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    return f"{root}/tables-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written table: evaluated once, and not again if an executor is lost."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
