"""A table that grows by one folder per micro-batch and folds them as it grows.

Micro-batch ``e`` writes folder (0, e). After every ``fan``-th folder of a level they are folded into one
of the next: folder (k, g) holds what the micro-batches from g * fan**k up to the next such folder wrote. So
after ``e`` micro-batches, the digits of ``e`` in base ``fan`` say which folders to read, at most fan - 1 of each level: a
reader needs no list of files, and a row is folded once per level. Everything depends on the number of the micro-batch
alone; a retried one writes the same folders again. Folders that were folded are removed one micro-batch
later, when no retry can need them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FAN = 8


@dataclass(frozen=True)
class EpochTable:
    """``path`` with rows of ``schema``; ``fold`` reduces the rows of several folders; ``partition`` is a column of them."""

    path: str
    schema: T.StructType
    fold: Callable[[DataFrame], DataFrame] = lambda rows: rows
    partition: tuple[str, ...] = ()
    fan: int = FAN

    def folder(self, level: int, group: int) -> str:
        return f"{self.path}/level={level}/group={group}"

    def folders(self, epochs: int) -> list[tuple[int, int]]:
        """The folders that hold the first ``epochs`` micro-batches, the oldest first."""
        out, level = [], 0
        while epochs:
            out += [(level, group) for group in range(epochs - epochs % self.fan, epochs)][::-1]
            epochs, level = epochs // self.fan, level + 1
        return out[::-1]

    def read(self, spark: SparkSession, epochs: int) -> DataFrame:
        """Rows of the first ``epochs`` micro-batches, as far as they are folded."""
        paths = [self.folder(*x) for x in self.folders(epochs)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths).select(self.schema.names)

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Put the rows of a micro-batch in their folder, fold full levels, remove what the last one folded."""
        spark = rows.sparkSession
        self._put(rows.select(self.schema.names), 0, epoch)
        level, done = 1, epoch + 1
        while done % self.fan == 0:
            done //= self.fan
            lower = [self.folder(level - 1, group) for group in range((done - 1) * self.fan, done * self.fan)]
            held = spark.read.schema(self.schema).option("basePath", self.path).parquet(*lower).select(self.schema.names)
            self._put(self.fold(held), level, done - 1)
            level += 1
        for folded in self._folded_before(epoch):
            remove(spark, self.folder(*folded))

    def _put(self, rows: DataFrame, level: int, group: int) -> None:
        writer = rows.repartition(*self.partition) if self.partition else rows
        writer.write.mode("overwrite").partitionBy(*self.partition).parquet(self.folder(level, group))

    def _folded_before(self, epoch: int) -> list[tuple[int, int]]:
        """What the fold after the micro-batch before ``epoch`` has made needless."""
        out, level, done = [], 0, epoch
        while done and done % self.fan == 0:
            out += [(level, group) for group in range(done - self.fan, done)]
            done, level = done // self.fan, level + 1
        return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder where Spark's own file system finds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def last_epoch(spark: SparkSession, path: str) -> int:
    """Number of the newest micro-batch that has written a mark below ``path``, -1 before the first."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return max((int(status.getPath().getName().split("=")[1]) for status in found or []), default=-1)
