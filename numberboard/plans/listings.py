"""Catalogue searches. All of them are one spine with different row conditions.

Spine: sellable plates -> current price and reaction counts -> viewer's reactions -> seller ->
projection -> sort -> page. Conditions on plates are applied before any join. The price ceiling is
applied to the current price only, so it can never let an older price through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.patterns import rule
from ..operators.envelope import tag_contained, tag_results
from ..operators.joins import (
    SELLER_COLUMNS,
    with_pattern,
    with_plates,
    with_seller,
    with_viewer_plates,
    with_viewer_store,
)
from ..operators.latest import is_latest, latest_price
from ..operators.ordering import TIE_BREAK, order_by, page, sort_key
from ..operators.projection import listing_columns
from ..operators.skew import keep_keys
from ..params import PlatesFilter, UsersFilter

Tables = Mapping[str, DataFrame]


def spine(
    tables: Tables,
    viewer: int,
    plates: DataFrame,
    *,
    single: bool = False,
    price_under: int | None = None,
    counts: str = "fanout",
) -> DataFrame:
    """Listing of the given plates, unsorted and with the base columns still in place.

    The price, like and save tables keep only the plates' rows before they are reduced to one row
    per plate; how, is for Catalyst and AQE to choose. Adaptive execution splits hot sellers.
    ``single`` promises at most one plate, with the tables already cut down to it.
    """
    raw = [tables[name] for name in ("price_history", "liked_plates", "saved_plates")]
    latest = latest_price(*(raw if single else [keep_keys(df, plates, "plates_id") for df in raw]), counts)
    # The plates_id joins share one partitioning; only the seller join needs another.
    df = with_plates(latest, plates).where(is_latest())
    if price_under is not None:
        df = df.where(P.price_at_most(price_under))
    df = with_viewer_plates(df, tables["liked_plates"], tables["saved_plates"], viewer)
    sellers = with_viewer_store(
        tables["users"].select(*SELLER_COLUMNS), tables["liked_store"], tables["saved_store"], viewer
    )
    return with_seller(df, sellers)


def sellable_plates(tables: Tables, *conditions: Column) -> DataFrame:
    plates = tables["plates"].where(P.is_sellable())
    for condition in conditions:
        plates = plates.where(condition)
    return plates


def _common(f: PlatesFilter) -> list[Column]:
    return [P.type_in(f.plates_type_id_list), P.province_in(f.province_id_list)]


def _listing(tables: Tables, f: PlatesFilter, plates: DataFrame) -> DataFrame:
    return spine(tables, f.users_id, plates, price_under=f.price_under, counts=f.counts)


def _sorted_page(df: DataFrame, f: PlatesFilter) -> DataFrame:
    ordered = df.orderBy(*order_by(f.sort_by, f.seed))
    return page(ordered, f.limit, f.offset)


def _search(tables: Tables, f: PlatesFilter, *conditions: Column) -> DataFrame:
    plates = sellable_plates(tables, *_common(f), *conditions)
    return _sorted_page(_listing(tables, f, plates), f).select(*listing_columns())


def _search_both(
    tables: Tables, f: PlatesFilter, exact: Column, suggestion: Column, *conditions: Column
) -> DataFrame:
    """Exact and suggested list. Every exact row is also a suggestion, so one spine serves both."""
    plates = sellable_plates(tables, *_common(f), *conditions, suggestion)
    suggested = _listing(tables, f, plates)
    if f.limit is None and not f.offset:
        ordered = suggested.orderBy(*order_by(f.sort_by, f.seed))
        tagged = tag_contained(ordered, exact)
        return tagged.select(*listing_columns(), "bucket")
    pages = (
        _sorted_page(rows, f).select(*listing_columns())
        for rows in (suggested.where(exact), suggested)
    )
    return tag_results(*pages)


def query_special_front(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search(tables, f, P.has_special_front())


def query_pattern(tables: Tables, f: PlatesFilter) -> DataFrame:
    """Members of one pattern; reads ``tables["plate_patterns"]`` and rejects an unknown name."""
    rule(f.pattern)
    plates = with_pattern(
        sellable_plates(tables, *_common(f)), tables["plate_patterns"], f.pattern
    )
    return _sorted_page(_listing(tables, f, plates), f).select(*listing_columns())


def query_plates_type_province(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search(tables, f, P.plates_type_is(f.plates_type_id), P.province_mode(f.province_id))


def query_vehicle_type_province(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search(tables, f, P.vehicle_type_is(f.vehicle_type_id), P.province_mode(f.province_id))


def query_suggestion_back_number(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search_both(
        tables, f, P.back_number_is(f.back_number), P.back_number_contains(f.back_number)
    )


def query_explore(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search(tables, f)


def _front_text(f: PlatesFilter) -> Column:
    return P.front_text_starts(f.search_text_front_text, f.wildcards)


def search_number_text_number(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search_both(
        tables,
        f,
        P.back_number_is(f.search_text_back_number),
        P.back_number_contains(f.search_text_back_number),
        P.front_number_is(f.search_text_front_number),
        _front_text(f),
    )


def search_number_text(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search(tables, f, P.front_number_is(f.search_text_front_number), _front_text(f))


def search_text_number(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search_both(
        tables,
        f,
        P.back_number_is(f.search_text_back_number),
        P.back_number_contains(f.search_text_back_number),
        _front_text(f),
    )


def search_text(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search(tables, f, _front_text(f))


def search_number(tables: Tables, f: PlatesFilter) -> DataFrame:
    return _search_both(
        tables,
        f,
        P.back_number_is(f.search_text_back_number),
        P.back_number_contains(f.search_text_back_number),
    )


# Search by the shape of the typed text: number-text-number, number-text, text-number, text,
# number, nothing. The ids callers send in ``search_text_pattern_id``.
TEXT_SEARCHES: dict[int, Callable[[Tables, PlatesFilter], DataFrame]] = {
    0: search_number_text_number,
    1: search_number_text,
    2: search_text_number,
    3: search_text,
    4: search_number,
    5: query_explore,
}


def query_plates_info(
    tables: Tables, viewer: int, plates_id: int, counts: str = "fanout"
) -> DataFrame:
    """One plate. The id condition is put on every table that carries it, so each scan is a point read."""
    by_id = P.plates_id_is(plates_id)
    narrowed = dict(tables)
    for name in ("price_history", "liked_plates", "saved_plates"):
        narrowed[name] = tables[name].where(by_id)
    plates = sellable_plates(tables, by_id)
    return spine(narrowed, viewer, plates, single=True, counts=counts).select(*listing_columns())


def _store_plates(tables: Tables, f: UsersFilter, pin_state: Column) -> DataFrame:
    plates = sellable_plates(tables, P.seller_is(f.store_id), pin_state)
    own = {name: tables[name].where(F.col("store_id") == f.store_id) for name in ("liked_store", "saved_store")}
    narrowed = {**tables, **own, "users": tables["users"].where(P.seller_is(f.store_id))}
    df = spine(narrowed, f.users_id, plates, counts=f.counts)
    return page(df.orderBy(*order_by("addDate")), f.limit, f.offset).select(*listing_columns())


def query_users_plates_pin(tables: Tables, f: UsersFilter) -> DataFrame:
    return _store_plates(tables, f, P.pinned())


def query_users_plates_unpin(tables: Tables, f: UsersFilter) -> DataFrame:
    return _store_plates(tables, f, P.not_pinned())


def sort_modes(tables: Tables, f: PlatesFilter, modes: tuple[str, ...]) -> DataFrame:
    """A page (``f.limit`` rows from ``f.offset`` on) of the explored plates under each sort mode.

    One spine: its rows are numbered per mode, and each task keeps only the rows that can be on a page.
    """
    rows = _listing(tables, f, sellable_plates(tables, *_common(f)))
    keys = []
    for mode in modes:
        nulls, value = sort_key(mode, f.seed)
        keys.append(F.struct(F.lit(mode).alias("sort_by"), nulls.alias("_nulls"), value.alias("_value")))
    ranked = rows.withColumn("_key", F.explode(F.array(*keys)))
    ties = [F.col(name).asc_nulls_last() for name in TIE_BREAK]
    place = F.row_number().over(Window.partitionBy("_key.sort_by").orderBy("_key._nulls", "_key._value", *ties))
    ranked = ranked.withColumn("_place", place)
    if f.limit is not None:
        ranked = ranked.where(F.col("_place") <= f.offset + f.limit)
    return ranked.where(F.col("_place") > f.offset).select(*listing_columns(), "_key.sort_by")
