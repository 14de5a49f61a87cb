"""Joins that stay balanced when one key holds a large part of all rows.

Rows are aggregated per key before they are shuffled into a join, so a hot key arrives as one row per
map task. Where raw rows must meet a per-key value, ``spread_lookup`` cuts the hot keys into slices.
Nothing is counted while a plan is built: the same plan serves every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above 1/HOT_SHARE of all rows, so there are always fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
# Below this many rows a key is never worth slicing.
HOT_ROWS = 1_000_000


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``. Put it below an aggregation: Catalyst and AQE pick the join."""
    return df.join(keys.select(on), on, "left_semi")


def hot_keys(sizes: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than 1/HOT_SHARE of all rows, and than ``hot_rows``, with the slices (``_slices``) they need.

    ``sizes`` has one row per key: the key and ``_rows``.
    """
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    slice_rows = F.greatest(F.floor(total / HOT_SHARE), F.lit(hot_rows))
    return sizes.where(F.col("_rows") > slice_rows).select(
        *on, F.ceil(F.col("_rows") / slice_rows).cast("int").alias("_slices")
    )


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: str,
    sizes: DataFrame,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join raw ``facts`` to the few ``lookup`` rows of their key without one task getting a hot key.

    The facts of hot keys (``hot_keys`` of ``sizes``) are cut into slices by a hash of ``spread_by``
    (a unique column, so a retried task repeats the same slice) and their lookup rows are repeated
    once per slice. Fewer than HOT_SHARE keys can be hot, so the list of hot keys is safe to
    broadcast; when it is empty AQE drops its joins.
    """
    on = list(on)
    hot = F.broadcast(hot_keys(sizes, on, hot_rows))
    slices = F.coalesce("_slices", F.lit(1))
    sliced_facts = (
        facts.join(hot, on, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(spread_by), slices).cast("int"))
        .drop("_slices")
    )
    sliced_lookup = (
        lookup.join(hot, on, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return sliced_facts.join(sliced_lookup, [*on, "_slice"], how).drop("_slice")
