"""Delivering the exact and the suggested list together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_results(exact: DataFrame, suggestion: DataFrame | None = None) -> DataFrame:
    """Both lists in one frame, told apart by ``bucket``."""
    tagged = exact.withColumn("bucket", F.lit("exact"))
    if suggestion is None:
        return tagged
    return tagged.unionByName(suggestion.withColumn("bucket", F.lit("suggestion")))


def tag_contained(suggestion: DataFrame, is_exact: Column) -> DataFrame:
    """``tag_results`` in one pass where the exact list is part of the suggested one and nothing is paged."""
    both = F.array(F.lit("exact"), F.lit("suggestion"))
    return suggestion.withColumn(
        "bucket", F.explode(F.when(is_exact, both).otherwise(F.array(F.lit("suggestion"))))
    )


def nest_page(tagged: DataFrame) -> DataFrame:
    """One row holding both lists as arrays. Only for a page: its size is the page limit, not the table."""
    row = F.struct(*[F.col(name) for name in tagged.columns if name != "bucket"])
    in_bucket = {name: F.when(F.col("bucket") == name, row) for name in ("exact", "suggestion")}
    return tagged.agg(*[F.collect_list(value).alias(name) for name, value in in_bucket.items()])
