"""A folder for what a query writes on its way."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.lru_cache(None)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
