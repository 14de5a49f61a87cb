"""The 61 number and text patterns.

A number pattern is read from its own name: equal letters stand for equal digits, different
letters for different digits, and digits stand for themselves. The length of the name fixes the
length of the number, so numbers outside 1..9999 match nothing and each number pattern is a short
list of numbers.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers that are a pattern of their own.
LUCKY_NUMBERS = (
    168, 789, 289, 456, 911, 718, 992, 35, 488,
    9, 99, 999, 9999, 7, 77, 777, 7777, 5, 55, 555, 5555, 8, 88, 888, 8888, 1,
    599, 595, 959, 955, 5959, 9595, 5599, 9955, 5995, 9559,
)
# Digit shapes.
SHAPES = (
    "x", "xx", "xxx", "xxxx", "xy", "xyy", "xyyy", "xxyy", "xyxy", "xyyx", "xyx",
)
# Runs of consecutive digits without a zero, and their step.
RUNS = {"xyz": 1, "zyx": -1, "wxyz": 1, "zyxw": -1}
# Any leading digit followed by these digits.
TAILS = ("x00", "x000", "x99", "x999", "x55", "x555")
# Front texts worth a pattern, with "prefix" or "whole" match.
FRONT_TEXTS = {
    "rakhang": ("ฆ", "prefix"),
    "kob": ("กบ", "whole"),
    "torthan": ("ฐ", "prefix"),
    "korkai_korkai": ("กก", "whole"),
}


# No number pattern is longer than four digits.
HIGHEST_NUMBER = 9999

NUMBER_PATTERNS = tuple(
    f"pattern_{name}" for name in (*LUCKY_NUMBERS, *SHAPES, *RUNS, *TAILS)
)
TEXT_PATTERNS = tuple(f"pattern_{name}" for name in FRONT_TEXTS)
PATTERN_NAMES = (*NUMBER_PATTERNS, *TEXT_PATTERNS)


def digit(column: Column | str, power: int) -> Column:
    """Decimal digit of a non-negative integer, counted from the right (0 = ones)."""
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value / F.lit(10**power)).cast("int") % 10


def _fits(name: str, number: str) -> bool:
    """Whether a number, as text, fits a pattern name without its prefix."""
    if name in RUNS:
        steps = {int(right) - int(left) for left, right in zip(number, number[1:])}
        return len(number) == len(name) and steps == {RUNS[name]} and "0" not in number
    if name in TAILS:
        return len(number) == len(name) and number.endswith(name[1:])
    if name in SHAPES:
        pairs = set(zip(name, number))
        return len(number) == len(name) and len(pairs) == len(set(name)) == len(set(number))
    return number == name


@cache
def numbers_by_pattern() -> dict[str, tuple[int, ...]]:
    """The numbers of every number pattern."""
    return {
        pattern: tuple(
            number
            for number in range(1, HIGHEST_NUMBER + 1)
            if _fits(pattern.removeprefix("pattern_"), str(number))
        )
        for pattern in NUMBER_PATTERNS
    }


def rule(pattern: str) -> Column:
    """Condition of one pattern; an unknown name is an error."""
    if pattern in NUMBER_PATTERNS:
        return F.col("back_number").isin(list(numbers_by_pattern()[pattern]))
    if pattern not in TEXT_PATTERNS:
        raise ValueError(f"unknown pattern {pattern!r}")
    text, match = FRONT_TEXTS[pattern.removeprefix("pattern_")]
    front = F.col("front_text")
    matches = front.startswith(text) if match == "prefix" else front == text
    return (F.col("front_number") == 0) & (F.col("vehicle_type_id") == 1) & matches


def matching(patterns: tuple[str, ...]) -> Column:
    """Array of those of the named patterns that a row matches."""
    return F.array_compact(F.array(*[F.when(rule(name), F.lit(name)) for name in patterns]))


def matches_any(patterns: tuple[str, ...]) -> Column:
    condition = F.lit(False)
    for name in patterns:
        condition |= rule(name)
    return condition
