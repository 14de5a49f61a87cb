"""Reading, appending to and replacing marketplace tables stored as Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import rule
from ..schemas import SCHEMAS

_LOG_SCHEMA = "version int"


def load_tables(
    spark: SparkSession, directory: str, names: Iterable[str] = SCHEMAS
) -> dict[str, DataFrame]:
    """Base tables ``<directory>/<name>`` with their declared schemas."""
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}") for name in names}


def pattern_members(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Memberships of one pattern from the published table partitioned by pattern: only its folder is read."""
    rule(name)
    return current(spark, root, "plate_patterns").where(F.col("pattern") == name)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table (INSERT)."""
    df.write.mode("append").parquet(path)


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the newest published version, 0 if there is none."""
    try:
        log = spark.read.schema(_LOG_SCHEMA).parquet(f"{root}/published")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    return log.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def publish(df: DataFrame, root: str, *partition_by: str) -> int:
    """Replace a table (the effect of UPDATE or DELETE) by writing its next version.

    The new version goes to its own folder and becomes current by one small append after the write
    has finished, so ``df`` may read the current version and readers never see half a table. A
    failed attempt leaves a folder nobody reads, which the next attempt overwrites. One writer at a time.
    """
    spark = df.sparkSession
    version = current_version(spark, root) + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/data/v={version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(
        f"{root}/published"
    )
    return version


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The newest published version of a table, with the declared schema of that name."""
    version = current_version(spark, root)
    if version == 0:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.schema(SCHEMAS[table]).parquet(f"{root}/data/v={version}")
