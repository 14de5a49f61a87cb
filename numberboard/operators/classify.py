"""Pattern memberships of plates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import TEXT_PATTERNS, matches_any, matching, numbers_by_pattern, rule


def number_patterns(spark: SparkSession) -> DataFrame:
    """(back_number, number_hits) of every number that matches a number pattern: at most 9999 rows."""
    hits: dict[int, list[str]] = {}
    for pattern, numbers in numbers_by_pattern().items():
        for number in numbers:
            hits.setdefault(number, []).append(pattern)
    columns = {
        "back_number": pa.array(hits.keys(), pa.int32()),
        "number_hits": pa.array(hits.values(), pa.list_(pa.string())),
    }
    return spark.createDataFrame(pa.table(columns))


def classify(plates: DataFrame, add_date: Column | None = None) -> DataFrame:
    """(plates_id, pattern, add_date), one row per plate and matching pattern. Narrow: no shuffle.

    The 57 number rules are evaluated once per number, not once per plate: plates look their number
    up in a broadcast table that cannot exceed 9999 rows. Only the four text rules run on each plate, and
    plates that match nothing are dropped before the memberships are unfolded.
    """
    when = F.col("add_date") if add_date is None else add_date
    lookup = F.broadcast(number_patterns(plates.sparkSession))
    no_hits = F.array().cast("array<string>")
    return (
        plates.join(lookup, "back_number", "left")
        .where(F.col("number_hits").isNotNull() | matches_any(TEXT_PATTERNS))
        .select(
            "plates_id",
            F.explode(
                F.concat(F.coalesce("number_hits", no_hits), matching(TEXT_PATTERNS))
            ).alias("pattern"),
            when.alias("add_date"),
        )
    )


def members_of(plates: DataFrame, name: str) -> DataFrame:
    """Memberships of one pattern straight from the catalogue: a plain filter on its rule."""
    return plates.where(rule(name)).select(
        "plates_id", F.lit(name).alias("pattern"), "add_date"
    )


def pattern_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("pattern").agg(F.count(F.lit(1)).alias("members"))
