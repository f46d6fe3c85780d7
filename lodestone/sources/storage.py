"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a temporary folder only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"
