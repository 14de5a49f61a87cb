"""Output columns of the listing and store queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import pg_timestamp_text


def _columns(*names: str) -> list[Column]:
    return [F.col(name) for name in names]


def listing_columns() -> list[Column]:
    """Plate, price, seller, viewer reactions and counts: 24 columns."""
    return [
        *_columns("plates_id", "front_text", "plates_type_id", "plates_uri", "total"),
        pg_timestamp_text("add_date").alias("add_date"),
        *_columns("front_number", "back_number", "vehicle_type_id", "users_id", "special_front_id"),
        *_columns("province_id", "information", "price", "name", "profile_uri"),
        *_columns("liked_plates_id", "saved_plates_id", "liked_store_id", "saved_store_id"),
        *_columns("liked_plates_id_count", "saved_plates_id_count", "reacts_count", "rownumber"),
    ]


def store_columns() -> list[Column]:
    """Seller, viewer reactions and totals: 14 columns."""
    return [
        *_columns("users_id", "name"),
        pg_timestamp_text("created_date").alias("created_date"),
        *_columns("profile_uri", "cover_uri", "information", "liked_store_id", "saved_store_id"),
        *_columns("liked_store_id_count", "saved_store_id_count", "reacts_count"),
        *_columns("total_assets", "plates_count", "average_score"),
    ]
