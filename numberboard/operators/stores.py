"""Per-seller totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import at_least_one, check_counts, count_by, current_price, or_zero

#: Products of counts pass 64 bits soon: three millions of ratings, likes and saves do.
WIDE = "decimal(38,0)"


def wide(x: Column) -> Column:
    return x.cast(WIDE)


def product(*factors: Column) -> Column:
    """Exact product of counts in 38 digits; null beyond, so that one store never stops the others."""
    out = wide(factors[0])
    for factor in factors[1:]:
        out = F.try_multiply(out, wide(factor)).cast(WIDE)
    return out


def store_reactions(
    rating: DataFrame, liked: DataFrame, saved: DataFrame, counts: str = "fanout"
) -> DataFrame:
    """Ratings, likes and saves per store that has any of them, with the plain average score.

    With ``fanout`` each count is multiplied by the other two (at least 1), as when the three
    tables are joined before counting; these products are DECIMAL(38,0), see ``narrowed``.
    """
    check_counts(counts)
    merged = (
        rating_by_store(rating)
        .join(count_by(liked, "store_id", "liked_store_id", "likes"), "store_id", "full")
        .join(count_by(saved, "store_id", "saved_store_id", "saves"), "store_id", "full")
    )
    liked_count, saved_count = or_zero("likes"), or_zero("saves")
    rated_count = or_zero("ratings")
    if counts == "fanout":
        liked_count, saved_count, rated_count = (
            product(liked_count, at_least_one("ratings"), at_least_one("saves")),
            product(saved_count, at_least_one("ratings"), at_least_one("likes")),
            product(rated_count, at_least_one("likes"), at_least_one("saves")),
        )
    return merged.select(
        "store_id",
        rated_count.alias("rating_id_count"),
        liked_count.alias("liked_store_id_count"),
        saved_count.alias("saved_store_id_count"),
        F.col("score").alias("average_score"),
    )


def rating_by_store(rating: DataFrame) -> DataFrame:
    """Joined rating rows and average score per store; a null score is a row but not part of the average."""
    return rating.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("ratings"), F.avg("score").alias("score")
    )


def store_totals(
    plates: DataFrame,
    price_history: DataFrame,
    rating: DataFrame,
    liked: DataFrame,
    saved: DataFrame,
    counts: str = "fanout",
) -> DataFrame:
    """One row per seller of the given plates that has a price: counts, asset sum, average score.

    Everything is reduced to one row per seller before the seller-level joins, so a seller with a
    third of all plates or ratings costs one partial row per task.
    """
    check_counts(counts)
    per_seller = (
        current_price(price_history)
        .join(plates.select("plates_id", "users_id"), "plates_id")
        .groupBy("users_id")
        .agg(F.count("plates_id").alias("plates"), F.sum("price").alias("assets"))
    )
    merged = per_seller
    for part in (
        rating_by_store(rating),
        count_by(liked, "store_id", "liked_store_id", "likes"),
        count_by(saved, "store_id", "saved_store_id", "saves"),
    ):
        merged = merged.join(part.withColumnRenamed("store_id", "users_id"), "users_id", "left")
    return merged.select("users_id", *total_columns(counts))


def total_columns(counts: str) -> list[Column]:
    plates, assets = F.col("plates"), F.col("assets")
    liked, saved = or_zero("likes"), or_zero("saves")
    if counts == "fanout":
        ratings, likes, saves = (at_least_one(name) for name in ("ratings", "likes", "saves"))
        liked, saved = product(plates, ratings, liked, saves), product(plates, ratings, likes, saved)
        assets, plates = product(assets, ratings, likes, saves), product(plates, ratings, likes, saves)
    return [
        liked.alias("liked_store_id_count"),
        saved.alias("saved_store_id_count"),
        (F.try_add(liked, saved).cast(WIDE) if counts == "fanout" else liked + saved).alias("reacts_count"),
        assets.alias("total_assets"),
        plates.alias("plates_count"),
        F.col("score").alias("average_score"),
    ]


def narrowed(df: DataFrame) -> DataFrame:
    """The wide columns as 64-bit integers, the type a count has in SQL; null where one doesn't fit."""
    kinds = dict(df.dtypes)
    return df.select([F.col(c).try_cast("bigint").alias(c) if kinds[c] == WIDE else F.col(c) for c in df.columns])
