"""Where jobs may write intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_OPTION = "spark.checkpoint.dir"


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster it is an error,
    since executors could not read each other's files.
    """
    shared = spark.conf.get(CHECKPOINT_OPTION, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_OPTION} to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="numberboard-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
