"""Explicit schemas of the marketplace tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

INT, LONG, TEXT, FLAG, INSTANT, SCORE = (
    T.IntegerType(),
    T.LongType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampNTZType(),
    T.DoubleType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _reaction(id_column: str, target: str) -> T.StructType:
    return _table(**{id_column: INT, "users_id": INT, target: INT, "add_date": INSTANT})


SCHEMAS: dict[str, T.StructType] = {
    "users": _table(
        users_id=INT, name=TEXT, email=TEXT, created_date=INSTANT, latest_sign_in=INSTANT,
        profile_uri=TEXT, cover_uri=TEXT, information=TEXT,
    ),
    "plates": _table(
        plates_id=INT, front_text=TEXT, plates_type_id=INT, plates_uri=TEXT, total=INT, add_date=INSTANT,
        front_number=INT, back_number=INT, vehicle_type_id=INT, users_id=INT, special_front_id=INT,
        province_id=INT, information=TEXT, is_selling=FLAG, is_temporary=FLAG, is_pin=FLAG, unique_text=TEXT,
    ),
    "price_history": _table(price_history_id=INT, plates_id=INT, price=INT, add_date=INSTANT),
    "liked_plates": _reaction("liked_plates_id", "plates_id"),
    "saved_plates": _reaction("saved_plates_id", "plates_id"),
    "liked_store": _reaction("liked_store_id", "store_id"),
    "saved_store": _reaction("saved_store_id", "store_id"),
    "rating": _table(rating_id=INT, users_id=INT, store_id=INT, score=SCORE, review=TEXT, add_date=INSTANT),
    "special_front": _table(special_front_id=INT, front=TEXT),
    "hashtag": _table(hashtag_id=INT, tag=TEXT, add_date=INSTANT),
    "plates_hashtag": _table(
        plates_hashtag_id=INT, plates_id=INT, hashtag_id=INT, add_date=INSTANT, unique_text=TEXT
    ),
    "transfer_plates": _table(
        transfer_plates_id=INT, plates_id=INT, users_id=INT, store_id=INT, add_date=INSTANT,
        received=FLAG, received_date=INSTANT,
    ),
    "verification": _table(
        verification_id=INT, reference=INT, code=INT, expire=INSTANT, verified=FLAG
    ),
    "plate_patterns": _table(plates_id=INT, add_date=INSTANT, pattern=TEXT),
}
