"""Store (seller) queries and key lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.joins import with_viewer_store
from ..operators.projection import store_columns
from ..operators.skew import keep_keys
from ..operators.stores import store_totals
from ..params import UsersFilter

Tables = Mapping[str, DataFrame]


def _store_rows(
    tables: Tables, f: UsersFilter, plates: DataFrame, users: DataFrame, narrowed: Tables
) -> DataFrame:
    totals = store_totals(
        plates,
        keep_keys(tables["price_history"], plates, "plates_id"),
        narrowed["rating"],
        narrowed["liked_store"],
        narrowed["saved_store"],
        f.counts,
    )
    stores = users.join(totals, "users_id")
    return with_viewer_store(
        stores, tables["liked_store"], tables["saved_store"], f.users_id
    ).select(*store_columns())


def search_users_info(tables: Tables, f: UsersFilter) -> DataFrame:
    """Stores whose name contains the text and that have a priced sellable plate.

    The two page fields are not applied. Plates are cut down to the matching sellers first.
    """
    users = tables["users"].where(P.seller_name_contains(f.search_text, f.wildcards))
    plates = keep_keys(tables["plates"].where(P.is_sellable()), users, "users_id")
    return _store_rows(tables, f, plates, users, tables)


def query_users_info(tables: Tables, f: UsersFilter) -> DataFrame:
    """One store: its id is put on every table that carries it."""
    own = P.seller_is(f.store_id)
    at_store = F.col("store_id") == f.store_id
    narrowed = {name: tables[name].where(at_store) for name in ("rating", "liked_store", "saved_store")}
    plates = tables["plates"].where(P.is_sellable() & own)
    return _store_rows(tables, f, plates, tables["users"].where(own), narrowed)


def fetch_special_front(special_front: DataFrame) -> DataFrame:
    """Every special front but the first ("none"), which is the one with the lowest id."""
    first = special_front.agg(F.min("special_front_id")).scalar()
    return special_front.where(F.col("special_front_id") > first).select("special_front_id", "front")


def fetch_profile(users: DataFrame, users_id: int) -> DataFrame:
    return users.where(P.seller_is(users_id)).select(
        "name", "email", "profile_uri", "cover_uri", "information"
    )
