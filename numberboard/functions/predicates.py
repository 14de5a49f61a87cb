"""Row conditions of the catalogue searches. Flags are three-valued, so NULL is handled on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPECIAL_FRONT = 1


def is_true(name: str) -> Column:
    """TRUE only; FALSE and NULL fail."""
    return F.col(name).eqNullSafe(F.lit(True))


def is_not_true(name: str) -> Column:
    """FALSE and NULL both pass."""
    return ~is_true(name)


def is_sellable() -> Column:
    return is_true("is_selling") & is_not_true("is_temporary")


def price_at_most(price: int) -> Column:
    """Only meaningful on the current price: never apply it to the raw history."""
    return F.col("price") <= F.lit(price)


def type_in(ids: Sequence[int]) -> Column:
    return _in("plates_type_id", ids)


def province_in(ids: Sequence[int]) -> Column:
    return _in("province_id", ids)


def _in(name: str, ids: Sequence[int]) -> Column:
    return F.col(name).isin(list(ids)) if ids else F.lit(False)


def has_special_front() -> Column:
    return F.col("special_front_id") != F.lit(NO_SPECIAL_FRONT)


def province_mode(mode: int) -> Column:
    """0: every province but the first; 1: only the first; otherwise any known province."""
    province = F.col("province_id")
    if mode == 0:
        return province != 1
    if mode == 1:
        return province == 1
    return province != 0


def plates_type_is(type_id: int) -> Column:
    return F.col("plates_type_id") == type_id


def vehicle_type_is(type_id: int) -> Column:
    return F.col("vehicle_type_id") == type_id


def front_number_is(number: int) -> Column:
    return F.col("front_number") == number


def back_number_is(number: int) -> Column:
    return F.col("back_number") == number


#: Back numbers of plates have up to four digits; others are compared as text.
BACK_NUMBERS = 10_000


def back_number_contains(number: int) -> Column:
    """The decimal digits of ``number`` occur anywhere in the back number.

    Two digits or more occur in few numbers: these are listed, as runs, so that Parquet's statistics can skip
    what holds none of them. One digit occurs in a third of all numbers, where nothing can be skipped.
    """
    text = F.col("back_number").cast("string").contains(str(number))
    if abs(number) < 10:
        return text
    runs: list[list[int]] = []
    for n in range(BACK_NUMBERS):
        if str(number) in str(n):
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
    single = [first for first, last in runs if first == last]
    listed = [f"back_number IN ({', '.join(map(str, single))})"] if single else []
    listed += [f"back_number BETWEEN {first} AND {last}" for first, last in runs if first < last]
    other = "back_number < 0 OR back_number >= {}".format(BACK_NUMBERS)
    return F.expr(f"({' OR '.join([*listed, other])})") & (F.expr(f"NOT ({other})") | text)


def front_text_starts(text: str, wildcards: bool = False) -> Column:
    """Prefix match on the literal text; with ``wildcards`` the text is a LIKE pattern."""
    column = F.col("front_text")
    return column.like(f"{text}%") if wildcards else column.startswith(text)


def seller_name_contains(text: str, wildcards: bool = False) -> Column:
    column = F.col("name")
    return column.like(f"%{text}%") if wildcards else column.contains(text)


def plates_id_is(plates_id: int) -> Column:
    return F.col("plates_id") == plates_id


def seller_is(users_id: int) -> Column:
    return F.col("users_id") == users_id


def pinned() -> Column:
    return is_true("is_pin")


def not_pinned() -> Column:
    return is_not_true("is_pin")
