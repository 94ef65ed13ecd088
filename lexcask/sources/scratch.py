"""A folder for files of one run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder (spark.checkpoint.dir); on one machine without it, below a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="lexcask-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"
