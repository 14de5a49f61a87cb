"""The joins of a listing. Join sides are left to Catalyst and AQE unless their size is proven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def with_plates(latest: DataFrame, plates: DataFrame) -> DataFrame:
    """Priced plates only: a plate without a price row disappears."""
    return plates.join(latest, "plates_id")


SELLER_COLUMNS = ("users_id", "name", "profile_uri")


def with_seller(df: DataFrame, sellers: DataFrame) -> DataFrame:
    """Adds the seller's columns; a plate whose seller is gone disappears.

    One seller may own a third of all plates. There is one row per seller (and reaction of the viewer) on the other side,
    so adaptive execution can cut a hot seller's plates into several tasks and repeat that row; that is
    left to it, as it knows the sizes without counting them first.
    """
    return df.join(sellers, "users_id")


def with_pattern(df: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Only members of the pattern, once per membership row."""
    wanted = members.where(F.col("pattern") == name).select("plates_id")
    return df.join(wanted, "plates_id")


def with_viewer_plates(df: DataFrame, liked: DataFrame, saved: DataFrame, viewer: int) -> DataFrame:
    """Adds the viewer's like and save of each plate; a repeated reaction repeats the row."""
    for table, id_column in ((liked, "liked_plates_id"), (saved, "saved_plates_id")):
        own = table.where(F.col("users_id") == viewer).select("plates_id", id_column)
        df = df.join(own, "plates_id", "left")
    return df


def with_viewer_store(df: DataFrame, liked: DataFrame, saved: DataFrame, viewer: int) -> DataFrame:
    """Adds the viewer's like and save of each seller; a repeated reaction repeats the row.

    Meant for rows per seller: join it to the sellers first, not to their plates.
    """
    for table, id_column in ((liked, "liked_store_id"), (saved, "saved_store_id")):
        own = table.where(F.col("users_id") == viewer).select(
            F.col("store_id").alias("users_id"), id_column
        )
        df = df.join(own, "users_id", "left")
    return df


def semi_filter(df: DataFrame, column: str, ids: Sequence[int]) -> DataFrame:
    """Rows whose column is in the caller's list; an empty list matches nothing."""
    return df.where(F.col(column).isin(sorted(set(ids)))) if ids else df.where(F.lit(False))
