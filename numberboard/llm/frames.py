"""Small helpers the text operators share: written intermediate tables and bounded reads."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numberboard.sources.workspace import workspace

#: Bytes of table rows that one shuffle partition should get.
PARTITION_BYTES = 24 << 20
#: Bytes of rows that a task hands to Python at once: rows of long texts would fill memory by the thousands.
ARROW_BYTES = 4 << 20
#: Settings of the allocators in Python workers: large arrays go back to the system as soon as they are freed.
#: Workers outlive their tasks, and what one stage let go would else count beside the next one's memory.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(256 << 10),
    "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
}
#: For operators that pass over long windows again and again: mapping each array afresh would cost more than the count.
WINDOW_MEMORY = WORKER_MEMORY | {"MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20)}
#: Catalyst's estimates from here on stand for "unknown".
UNKNOWN_BYTES = 1 << 53


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine find the package; elsewhere it is installed or sent with ``--py-files``.

    Also bounds what they are handed at once and what they hold on to; settings made elsewhere stay.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known.get("PYTHONPATH"))))
    for name, value in WORKER_MEMORY.items():
        known.setdefault(name, value)


@contextmanager
def worker_memory(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Functions handed to Spark inside run in Python workers of these settings, in place of WORKER_MEMORY's; settings
    made elsewhere stay."""
    known = spark.sparkContext.environment
    ours = {name: value for name, value in WORKER_MEMORY.items() if known.get(name) == value}
    known.update({name: settings[name] for name in ours})
    try:
        yield
    finally:
        known.update(ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives a lost executor."""
    path = workspace(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the folder of a table made by ``written`` that no later plan reads."""
    spark = table.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> int:
    """How many parts the tasks that read ``df`` should deal their blocks to.

    Follows the size that Catalyst states for a table, so that a part stays as small when the input
    grows; the session's shuffle partitions where the size is unknown, as of rows made in the driver.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = math.ceil(size / PARTITION_BYTES) if size < UNKNOWN_BYTES else 0
    return min(1 << 16, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted))


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """The identifier, the text and the columns asked for, free of whatever else the table holds."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def crc_share(column: str, parts: int):
    """Remainder of the CRC-32 of an identifier written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
