"""Current price per plate and the like / save counts that go with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_MODES = ("fanout", "distinct")


def latest_by(df: DataFrame, key: Sequence[str] | str, order: str) -> DataFrame:
    """Whole latest row per key, the latest being the one with the highest (unique) ``order``.

    One partially aggregated shuffle: a hot key sends one row per map task, not its whole history.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [name for name in df.columns if name not in keys and name != order]
    newest = df.groupBy(*keys).agg(
        F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("_row")
    )
    return newest.select(*keys, order, "_row.*").select(*df.columns)


def current_price(price_history: DataFrame) -> DataFrame:
    """(plates_id, price_history_id, price) of the newest price row; integer buffers keep it hash-aggregated."""
    return price_history.groupBy("plates_id").agg(
        F.max("price_history_id").alias("price_history_id"),
        F.max_by("price", "price_history_id").alias("price"),
    )


def count_by(df: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Non-null ``counted`` values per key."""
    return df.groupBy(key).agg(F.count(counted).alias(name))


def at_least_one(name: str) -> Column:
    return F.greatest(F.coalesce(name, F.lit(0)), F.lit(1)).cast("bigint")


def or_zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("bigint")


def check_counts(counts: str) -> None:
    if counts not in COUNT_MODES:
        raise ValueError(f"counts must be one of {COUNT_MODES}, not {counts!r}")


def plate_reactions(liked: DataFrame, saved: DataFrame, counts: str = "fanout") -> DataFrame:
    """Likes, saves and their sum per plate that has any.

    ``fanout``: every like is counted once per save and the reverse, as when both tables are joined
    before counting. Computed from the two plain counts, so no pair of rows is ever built.
    ``distinct``: the plain counts.
    """
    check_counts(counts)
    both = count_by(liked, "plates_id", "liked_plates_id", "likes").join(
        count_by(saved, "plates_id", "saved_plates_id", "saves"), "plates_id", "full"
    )
    return both.select("plates_id", *reaction_counts("likes", "saves", counts))


def reaction_counts(likes: str, saves: str, counts: str) -> list[Column]:
    """The three reported counts from the plain ones."""
    liked, saved = or_zero(likes), or_zero(saves)
    if counts == "fanout":
        liked, saved = liked * at_least_one(saves), saved * at_least_one(likes)
    return [
        liked.alias("liked_plates_id_count"),
        saved.alias("saved_plates_id_count"),
        (liked + saved).alias("reacts_count"),
    ]


def latest_price(
    price_history: DataFrame, liked: DataFrame, saved: DataFrame, counts: str = "fanout"
) -> DataFrame:
    """One row per priced plate: current price, reaction counts and ``rownumber`` (always 1).

    The three tables are one union below one aggregation, so a task holds one hash map instead of three
    and the sorts that would join them. A row without a plate is a price only, as no reaction joins it.
    """
    check_counts(counts)
    met = price_history.select("plates_id", "price_history_id", "price", F.lit(1).alias("_priced"))
    for df, counted in ((liked, "liked_plates_id"), (saved, "saved_plates_id")):
        own = df.where(F.col("plates_id").isNotNull()).select("plates_id", counted)
        met = met.unionByName(own, allowMissingColumns=True)
    newest = met.groupBy("plates_id").agg(
        F.max("price_history_id").alias("price_history_id"),
        F.max_by("price", "price_history_id").alias("price"),
        F.count("liked_plates_id").alias("_likes"),
        F.count("saved_plates_id").alias("_saves"),
        F.count("_priced").alias("_prices"),
    )
    return newest.where(F.col("_prices") > 0).select(
        "plates_id",
        "price_history_id",
        "price",
        *reaction_counts("_likes", "_saves", counts),
        F.lit(1).cast("bigint").alias("rownumber"),
    )


def is_latest() -> Column:
    return F.col("rownumber") == 1
