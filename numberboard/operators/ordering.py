"""Sorting and paging. Every order ends in the row's ids, so a page is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIE_BREAK = (
    "plates_id",
    "liked_plates_id",
    "saved_plates_id",
    "liked_store_id",
    "saved_store_id",
)


def order_by(sort_by: str, seed: int = 0) -> list[Column]:
    """Sort columns of a mode; an unknown mode sorts by newest first. Missing values sort as the largest."""
    leading = {
        "priceLowToHigh": F.col("price").asc_nulls_last(),
        "priceHighToLow": F.col("price").desc_nulls_first(),
        "reacts": F.col("reacts_count").desc_nulls_first(),
        "random": F.xxhash64("plates_id", F.lit(seed)).asc(),
    }.get(sort_by, F.col("add_date").desc_nulls_first())
    return [leading, *(F.col(name).asc_nulls_last() for name in TIE_BREAK)]


def sort_key(sort_by: str, seed: int = 0) -> tuple[Column, Column]:
    """The leading column of ``order_by`` as two whole numbers that sort upwards: null rank and value."""
    if sort_by == "random":
        return F.lit(0), F.xxhash64("plates_id", F.lit(seed))
    if sort_by == "priceLowToHigh":
        return F.col("price").isNull().cast("int"), F.col("price").cast("long")
    value = {
        "priceHighToLow": F.col("price").cast("long"),
        "reacts": F.col("reacts_count").cast("long"),
    }.get(sort_by, F.unix_micros(F.col("add_date").cast("timestamp")))
    return value.isNotNull().cast("int"), -value


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """OFFSET then LIMIT of an already sorted frame; planned as one top-k, never as a full sort."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
