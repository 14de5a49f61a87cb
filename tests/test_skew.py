"""Hot keys: results stay whole and no slice holds more than its share."""

import re

import pytest
from pyspark.sql import functions as F

from numberboard.operators.joins import with_seller
from numberboard.operators.latest import latest_price
from numberboard.operators.skew import hot_keys, keep_keys, spread_lookup
from numberboard.session import INITIAL_PARTITIONS, TASK_OPTIONS, tune


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows share key 1."""
    return spark.range(30_000).select(
        F.col("id").cast("int").alias("fact"),
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 997) + 2).cast("int").alias("k"),
    )


def sizes_of(facts, key="k"):
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_hot_key_is_spread_and_rows_are_whole(spark, facts, how, hot_rows):
    lookup = spark.range(1, 900).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    plain = facts.join(lookup, "k", how)
    spread = spread_lookup(facts, lookup, ["k"], "fact", sizes_of(facts), how, hot_rows)
    assert spread.columns == plain.columns
    assert spread.count() == plain.count()
    assert spread.exceptAll(plain).isEmpty()


def test_hot_keys_are_few_and_their_slices_even(facts):
    hot = hot_keys(sizes_of(facts), ["k"], 100).collect()
    assert [(row.k, row._slices) for row in hot] == [(1, 100)]
    slices = facts.where("k = 1").groupBy(F.pmod(F.xxhash64("fact"), F.lit(100)).alias("s")).count()
    assert slices.count() == 100 and slices.agg(F.max("count")).first()[0] < 200


def test_spread_join_is_by_key_and_slice(spark, facts):
    lookup = spark.range(1, 900).select(F.col("id").cast("int").alias("k"))
    joined = spread_lookup(facts, lookup, ["k"], "fact", sizes_of(facts), "inner", 100)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[k#\d+, _slice#\d+\], \[k#\d+, _slice#\d+\], Inner", plan)


def test_duplicate_lookup_rows_multiply(spark):
    facts = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "fact int, k int")
    lookup = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    got = spread_lookup(facts, lookup, ["k"], "fact", sizes_of(facts), "left", 1).collect()
    assert sorted((row.fact, row.v) for row in got if row.v) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert len(got) == 5


def test_hot_seller(spark):
    """A seller with a third of all plates is cut into several tasks, and no plate is lost."""
    plates = spark.range(60_000).select(
        F.col("id").cast("int").alias("plates_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("users_id"),
    )
    sellers = spark.range(60_000).where("id % 3 <> 0 AND id <> 8").select(F.col("id").cast("int").alias("users_id"), F.lit("known").alias("name"))
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key) for key in options if key != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        listed = with_seller(plates.repartition(8), sellers)
        found = listed.collect()
        assert len(found) == len({row.plates_id for row in found}) == 59_999
        assert "SortMergeJoin(skew=true)" in listed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for key, value in before.items():
            spark.conf.set(key, value)


def test_keep_keys(spark):
    rows = spark.range(20).withColumnRenamed("id", "k")
    assert keep_keys(rows, rows.where("k < 3").union(rows.where("k = 1")), "k").count() == 3


def test_catalogue_tasks_are_handed_bounded_bytes(spark):
    """Only the catalogue's queries set the sizes, and training text that follows in the session loses them again."""
    before = {key: spark.conf.get(key) for key in TASK_OPTIONS}
    assert all(tune(spark).conf.get(key) == value for key, value in TASK_OPTIONS.items())
    assert {key: tune(spark, catalogue=False).conf.get(key) for key in TASK_OPTIONS} != TASK_OPTIONS
    for key, value in before.items():
        spark.conf.set(key, value)


def test_current_price_and_counts_are_one_aggregation(spark):
    """No join, whose sorts a listing's task would hold beside each other; rows without a plate or a price stay apart."""
    prices = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 2, 5), (None, 3, 7), (4, None, 8)], "price_history_id int, plates_id int, price int")
    liked = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None), (None, 2)], "liked_plates_id int, plates_id int")
    saved = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "saved_plates_id int, plates_id int")
    found = latest_price(prices, liked, saved, "distinct")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.plates_id: (r.price_history_id, r.price, r.liked_plates_id_count, r.saved_plates_id_count, r.reacts_count) for r in found.collect()}
    assert rows == {1: (2, 20, 2, 1, 3), 2: (3, 5, 0, 1, 1), 3: (None, None, 0, 0, 0), None: (4, 8, 0, 0, 0)}


def test_initial_partitions_are_for_the_catalogue(spark):
    key, value = INITIAL_PARTITIONS
    before = spark.conf.get(key, None)
    assert tune(spark).conf.get(key) == value and tune(spark, catalogue=False).conf.get(key, "1") != value
    if before:
        spark.conf.set(key, before)
