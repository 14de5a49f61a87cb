"""Search parameters, as plain immutable records."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PlatesFilter:
    """One catalogue search. ``limit=None`` returns every row; the two id lists match nothing when empty.

    ``search_text`` and ``search_text_pattern_id`` are carried for callers that route on them; no
    plate query reads them.
    """

    plates_id: int = 0
    users_id: int = 0
    pattern: str = ""
    plates_type_id: int = 0
    province_id: int = 0
    vehicle_type_id: int = 0
    search_text: str = ""
    search_text_pattern_id: int = 5
    search_text_front_number: int = 0
    search_text_front_text: str = ""
    search_text_back_number: int = 0
    back_number: int = 0
    price_under: int = 2_147_483_647
    sort_by: str = "addDate"
    plates_type_id_list: tuple[int, ...] = ()
    province_id_list: tuple[int, ...] = ()
    limit: int | None = None
    offset: int = 0
    seed: int = 0
    counts: str = "fanout"
    wildcards: bool = False


@dataclass(frozen=True)
class UsersFilter:
    """One store search. The two store-total queries ignore ``limit`` and ``offset``."""

    users_id: int = 0
    store_id: int = 0
    search_text: str = ""
    limit: int | None = None
    offset: int = 0
    counts: str = "fanout"
    wildcards: bool = False
