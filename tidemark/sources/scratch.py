"""The shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is named and Spark runs in this
    process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (context.master + "[").startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    # Spark's own form of it: in full, so that a path without a scheme is not taken for a local one.
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path, not made yet, inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: what reads them twice works them out once, and no lost
    executor reruns what lies before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
