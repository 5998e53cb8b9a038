"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the shared one that `spark.checkpoint.dir` names.

    Only a local master, whose tasks share the driver's disk, may leave it unset, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"{tempfile.gettempdir()}/storelens"
    return f"{shared.rstrip('/')}/storelens-{uuid.uuid4().hex}"
