"""The classifier against the rules stated a second time, on every number."""

import pytest
from pyspark.sql import functions as F

from numberboard.functions.patterns import PATTERN_NAMES, rule
from numberboard.operators.classify import classify, members_of


def stated(number: int) -> set[str]:
    """Number patterns of a number, from divisions and remainders."""
    if not 0 < number < 10_000:
        return set()
    lucky = {
        168, 789, 289, 456, 911, 718, 992, 35, 488, 9, 99, 999, 9999, 7, 77, 777, 7777, 5, 55, 555,
        5555, 8, 88, 888, 8888, 1, 599, 595, 959, 955, 5959, 9595, 5599, 9955, 5995, 9559,
    }
    found = {str(number)} if number in lucky else set()
    digits = [int(char) for char in str(number)]
    size = len(digits)
    if len(set(digits)) == 1:
        found.add("x" * size)
    same = {
        "xy": [(0,), (1,)], "xyy": [(0,), (1, 2)], "xyx": [(0, 2), (1,)], "xyyy": [(0,), (1, 2, 3)],
        "xxyy": [(0, 1), (2, 3)], "xyxy": [(0, 2), (1, 3)], "xyyx": [(0, 3), (1, 2)],
    }
    for name, groups in same.items():
        if size == len(name):
            values = [{digits[place] for place in group} for group in groups]
            if all(len(value) == 1 for value in values) and values[0] != values[1]:
                found.add(name)
    if number in (123, 234, 345, 456, 567, 678, 789):
        found.add("xyz")
    if number in (321, 432, 543, 654, 765, 876, 987):
        found.add("zyx")
    if number in (1234, 2345, 3456, 4567, 5678, 6789):
        found.add("wxyz")
    if number in (4321, 5432, 6543, 7654, 8765, 9876):
        found.add("zyxw")
    for rest in (0, 99, 55):
        if size == 3 and number % 100 == rest:
            found.add(f"x{rest:02d}")
    for rest in (0, 999, 555):
        if size == 4 and number % 1000 == rest:
            found.add(f"x{rest:03d}")
    return found


@pytest.fixture(scope="module")
def all_numbers(spark):
    return spark.range(-1, 10_002).select(
        F.col("id").cast("int").alias("plates_id"),
        F.col("id").cast("int").alias("back_number"),
        F.lit(0).alias("front_number"),
        F.lit(1).alias("vehicle_type_id"),
        F.lit("งจ").alias("front_text"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("add_date"),
    )


def test_every_number(all_numbers):
    got: dict[int, list[str]] = {}
    for row in classify(all_numbers).collect():
        got.setdefault(row.plates_id, []).append(row.pattern.removeprefix("pattern_"))
    for number in range(-1, 10_002):
        found = got.get(number, [])
        assert len(found) == len(set(found))
        assert set(found) == stated(number), number


def test_there_are_61_patterns():
    assert len(PATTERN_NAMES) == len(set(PATTERN_NAMES)) == 61


def test_members_of_equals_classify(all_numbers):
    for name in ("pattern_xyx", "pattern_x999", "pattern_x"):
        whole = classify(all_numbers).where(F.col("pattern") == name).select("plates_id")
        single = members_of(all_numbers, name).select("plates_id")
        assert sorted(whole.collect()) == sorted(single.collect())


def test_front_texts(spark):
    rows = [
        (1, "ฆก", 0, 1), (2, "ฆ", 0, 1), (3, "กบ", 0, 1), (4, "กบข", 0, 1), (5, "ฐข", 0, 1),
        (6, "กก", 0, 1), (7, "กก", 1, 1), (8, "กก", 0, 2), (9, "ก", 0, 1), (10, None, 0, 1),
    ]
    plates = spark.createDataFrame(
        rows, "plates_id int, front_text string, front_number int, vehicle_type_id int"
    ).selectExpr("*", "10000 AS back_number", "TIMESTAMP_NTZ '2024-01-01' AS add_date")
    got = {(row.plates_id, row.pattern) for row in classify(plates).collect()}
    assert got == {
        (1, "pattern_rakhang"), (2, "pattern_rakhang"), (3, "pattern_kob"),
        (5, "pattern_torthan"), (6, "pattern_korkai_korkai"),
    }


def test_unknown_pattern_is_an_error(spark):
    with pytest.raises(ValueError):
        rule("pattern_nothing")


def test_plates_without_hits_are_not_shuffled(all_numbers):
    plan = classify(all_numbers)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
