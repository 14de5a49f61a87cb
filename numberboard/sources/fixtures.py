"""Marketplace tables derived from the generated test tables.

Every statement runs unchanged in Spark and DuckDB; a name in braces is another view or a test
table. Each reads its whole input: no sampling and no id subsets. An order is a plate, a customer a
seller, an order line a price row, an event a reaction, a rating or a request. Sellers of some
plates have left the marketplace (negative id), some plates have no price row, and the three flags
carry TRUE, FALSE and NULL.
"""

from __future__ import annotations

import string
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Declared schemas of the test tables the views read, so that no footer is read to infer them.
SOURCE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

VIEWS: dict[str, str] = {
    "users": """
SELECT CAST(c_custkey AS INT) AS users_id, c_name AS name,
 CONCAT(LOWER(REPLACE(c_name, '#', '.')), '@example.com') AS email,
 TIMESTAMP '2024-01-01 00:00:00' AS created_date,
 TIMESTAMP '2024-01-01 00:00:00' AS latest_sign_in,
 CASE WHEN c_custkey % 3 = 0 THEN CONCAT('profile/', CAST(c_custkey AS STRING)) END AS profile_uri,
 CASE WHEN c_custkey % 4 = 0 THEN CONCAT('cover/', CAST(c_custkey AS STRING)) END AS cover_uri,
 CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS information
FROM {customer}""",
    "plates": """
SELECT p.*, CONCAT('province_id(', CAST(province_id AS STRING), ')-vehicle_type_id(', CAST(vehicle_type_id AS STRING),
 ')-front_number(', CAST(front_number AS STRING), ')-front_text(', front_text, ')-back_number(',
 CAST(back_number AS STRING), ')') AS unique_text
FROM (
SELECT CAST(o_orderkey AS INT) AS plates_id,
 CASE CAST(FLOOR(o_orderkey / 3) AS INT) % 8 WHEN 0 THEN 'กก' WHEN 1 THEN 'กบ' WHEN 2 THEN 'ฆก' WHEN 3 THEN 'ฐข'
  WHEN 4 THEN 'กขค' WHEN 5 THEN 'งจ' WHEN 6 THEN 'ฆ' ELSE 'ขก' END AS front_text,
 CAST(1 + o_orderkey % 10 AS INT) AS plates_type_id,
 CASE WHEN o_orderkey % 6 = 0 THEN CONCAT('plates/', CAST(o_orderkey AS STRING)) END AS plates_uri,
 CAST(1 + o_orderkey % 4 AS INT) AS total, o_orderdate AS add_date,
 CAST(CAST(FLOOR(o_orderkey / 24) AS INT) % 3 AS INT) AS front_number,
 CAST(o_orderkey % 10000 AS INT) AS back_number,
 CAST(1 + o_orderkey % 3 AS INT) AS vehicle_type_id,
 CAST(CASE WHEN o_custkey % 50 = 49 THEN -1 - o_custkey ELSE o_custkey END AS INT) AS users_id,
 CAST(1 + CAST(FLOOR(o_orderkey / 2) AS INT) % 4 AS INT) AS special_front_id,
 CAST(o_orderkey % 9 AS INT) AS province_id,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS information,
 CASE WHEN o_orderkey % 11 = 0 THEN FALSE WHEN o_orderkey % 13 = 0 THEN NULL ELSE TRUE END AS is_selling,
 CASE WHEN o_orderkey % 17 = 0 THEN TRUE WHEN o_orderkey % 19 = 0 THEN FALSE END AS is_temporary,
 CASE WHEN o_orderkey % 7 = 0 THEN TRUE WHEN o_orderkey % 5 = 0 THEN FALSE END AS is_pin
FROM {orders}
) AS p""",
    "price_rows": """
SELECT CAST(l_orderkey * 8 + l_linenumber AS INT) AS price_history_id, CAST(l_orderkey AS INT) AS plates_id,
 CAST(FLOOR(l_extendedprice) AS INT) AS price, l_shipdate AS add_date
FROM {lineitem}""",
    "price_history": """
SELECT price_history_id, plates_id, MAX(price) AS price, MAX(add_date) AS add_date
FROM {price_rows} GROUP BY price_history_id, plates_id""",
    "price_requests": """
SELECT CAST(event_id AS INT) AS request_id, CAST(FLOOR(event_id / 10) AS INT) AS plates_id,
 CAST(1 + FLOOR(value * 100) AS INT) AS price
FROM {events} WHERE event_type = 'view'""",
    "liked_plates": """
SELECT CAST(event_id AS INT) AS liked_plates_id, CAST(user_id AS INT) AS users_id,
 CAST(FLOOR(event_id / 10) AS INT) AS plates_id, ts AS add_date
FROM {events} WHERE event_type = 'click'""",
    "saved_plates": """
SELECT CAST(event_id AS INT) AS saved_plates_id, CAST(user_id AS INT) AS users_id,
 CAST(FLOOR(event_id / 10) AS INT) AS plates_id, ts AS add_date
FROM {events} WHERE event_type = 'purchase'""",
    "liked_store": """
SELECT CAST(event_id AS INT) AS liked_store_id, CAST(user_id AS INT) AS users_id,
 CAST(FLOOR(event_id / 20) AS INT) AS store_id, ts AS add_date
FROM {events} WHERE event_type = 'signup'""",
    "saved_store": """
SELECT CAST(event_id AS INT) AS saved_store_id, CAST(user_id AS INT) AS users_id,
 CAST(FLOOR(event_id / 20) AS INT) AS store_id, ts AS add_date
FROM {events} WHERE event_type = 'error'""",
    "rating": """
SELECT CAST(event_id AS INT) AS rating_id, CAST(user_id AS INT) AS users_id,
 CAST(FLOOR(event_id / 20) AS INT) AS store_id,
 CAST(1 + CAST(FLOOR(value) AS INT) % 5 AS DOUBLE) AS score, ts AS add_date
FROM {events} WHERE event_type = 'view'""",
    "special_front": """
SELECT CAST(n_nationkey + 1 AS INT) AS special_front_id,
 CASE WHEN n_nationkey = 0 THEN '' ELSE n_name END AS front
FROM {nation}""",
    "hashtag": """
SELECT CAST(p_partkey AS INT) AS hashtag_id, p_name AS tag, (SELECT MIN(o_orderdate) FROM {orders}) AS add_date
FROM {part}""",
    "hashtag_requests": """
SELECT CAST(p_partkey AS INT) AS request_id, p_type AS tag
FROM {part}""",
    "plates_hashtag": """
SELECT CAST(o_orderkey AS INT) AS plates_hashtag_id, CAST(o_orderkey AS INT) AS plates_id,
 CAST(o_custkey % 5 AS INT) AS hashtag_id, o_orderdate AS add_date,
 CONCAT('plates_id(', CAST(o_orderkey AS STRING), ')-hashtag_id(', CAST(o_custkey % 5 AS STRING), ')') AS unique_text
FROM {orders}""",
    "new_plates_hashtag": """
SELECT CAST(l_orderkey AS INT) AS plates_id, CAST(l_partkey % 5 AS INT) AS hashtag_id,
 l_shipdate AS add_date, CAST(l_linenumber AS INT) AS seq
FROM {lineitem}""",
    "transfer_plates": """
SELECT CAST(event_id AS INT) AS transfer_plates_id, CAST(FLOOR(event_id / 10) AS INT) AS plates_id,
 CAST(event_id % 100 AS INT) AS users_id, CAST(user_id AS INT) AS store_id, ts AS add_date,
 value > 50 AS received, CASE WHEN value > 50 THEN ts + INTERVAL 1 HOUR END AS received_date
FROM {events} WHERE event_type = 'view'""",
    "transfer_requests": """
SELECT CAST(event_id AS INT) AS request_id, CAST(FLOOR(event_id / 10) AS INT) AS plates_id,
 CAST(event_id % 100 AS INT) AS users_id, CAST(user_id AS INT) AS store_id, ts AS add_date
FROM {events} WHERE event_type = 'purchase'""",
    "accept_requests": """
SELECT CAST(event_id AS INT) AS request_id,
 CAST(event_id - CAST(FLOOR(value) AS INT) % 4 AS INT) AS transfer_plates_id,
 ts - INTERVAL 1 HOUR * CAST(event_id % 90 AS INT) AS received_date
FROM {events} WHERE event_type = 'click'""",
    "reaction_log": """
SELECT CAST(event_id AS INT) AS event_id, CAST(user_id % 20 AS INT) AS users_id,
 CAST(FLOOR(event_id / 100) AS INT) AS plates_id,
 CASE WHEN event_type = 'click' THEN 'add' ELSE 'remove' END AS op, ts
FROM {events} WHERE event_type IN ('click', 'error')""",
    "verification": """
SELECT CAST(event_id AS INT) AS verification_id, CAST(1 + event_id % 99 AS INT) AS reference,
 CAST(10000 + (event_id * 7919) % 990000 AS INT) AS code, ts + INTERVAL 15 MINUTE AS expire,
 event_id % 10 = 0 AS verified
FROM {events} WHERE event_type = 'signup'""",
    "verification_attempt": """
SELECT CAST(event_id AS INT) AS attempt_id, CAST(event_id AS INT) AS verification_id,
 CAST(1 + event_id % 99 AS INT) AS reference,
 CAST(10000 + (event_id * 7919) % 990000 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS INT) AS code,
 ts + INTERVAL 1 MINUTE * CAST(event_id % 30 AS INT) AS attempt_ts
FROM {events} WHERE event_type = 'signup'
UNION ALL
SELECT CAST(event_id + 1000000000 AS INT) AS attempt_id, CAST(event_id AS INT) AS verification_id,
 CAST(1 + event_id % 99 AS INT) AS reference, CAST(10000 + (event_id * 7919) % 990000 AS INT) AS code,
 ts + INTERVAL 1 MINUTE * CAST(event_id % 20 AS INT) AS attempt_ts
FROM {events} WHERE event_type = 'signup'""",
    "signup_batch": """
SELECT CAST(c_custkey AS INT) AS request_id,
 CASE WHEN c_custkey % 3 = 0 THEN CONCAT('  ', UPPER(REPLACE(c_name, '#', '.')), '@EXAMPLE.COM ')
  WHEN c_custkey % 3 = 1 THEN CONCAT('new', CAST(CAST(FLOOR(c_custkey / 6) AS INT) AS STRING), '@Example.com')
  ELSE c_name END AS email
FROM {customer}""",
    "new_plates_batch": """
SELECT plates_id AS request_id, front_text, plates_type_id, total, front_number,
 CASE WHEN plates_id % 4 = 0 THEN back_number ELSE 9000 + CAST(FLOOR(plates_id / 40) AS INT) % 50 END AS back_number,
 vehicle_type_id, users_id, special_front_id, province_id, information, 1000 + back_number AS price,
 plates_id % 6 = 0 AS is_temporary
FROM {plates}""",
    "pin_requests": """
SELECT CAST(event_id AS INT) AS request_id, CAST(event_id % 400 AS INT) AS plates_id
FROM {events} WHERE event_type = 'click'""",
    "unpin_requests": """
SELECT CAST(l_orderkey AS INT) AS plates_id FROM {lineitem}
UNION ALL
SELECT CAST(o_orderkey AS INT) AS plates_id FROM {orders} WHERE o_orderstatus = 'F'""",
    "plate_edits": """
SELECT CAST(l_orderkey * 8 + l_linenumber AS INT) AS request_id, CAST(l_orderkey AS INT) AS plates_id,
 CASE WHEN MIN(l_returnflag) <> 'N' THEN MIN(l_returnflag) END AS information,
 MIN(l_linestatus) = 'O' AS is_selling, CAST(MAX(l_quantity) AS INT) AS total,
 l_linenumber <> 1 AS edits_information, l_linenumber <> 2 AS edits_is_selling,
 l_linenumber <> 3 AS edits_total
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "user_edits": """
SELECT CAST(event_id AS INT) AS request_id, CAST(user_id AS INT) AS users_id,
 CONCAT('seller ', CAST(event_id AS STRING)) AS name,
 CASE WHEN event_type = 'view' THEN props END AS information, ts AS latest_sign_in,
 event_type = 'click' AS edits_name, event_type IN ('view', 'error') AS edits_information,
 event_type = 'signup' AS edits_latest_sign_in
FROM {events}""",
    "delete_requests": """
SELECT CAST(FLOOR(event_id / 10) AS INT) AS plates_id FROM {events} WHERE event_type = 'error'""",
    "media_requests": """
SELECT CAST(event_id AS INT) AS request_id, CAST(FLOOR(event_id / 10) AS INT) AS id,
 CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'profile/profile_'
  WHEN 1 THEN CONCAT('profile/profile_', CAST(event_id AS STRING))
  WHEN 2 THEN CONCAT('cover/cover_', CAST(event_id AS STRING))
  WHEN 3 THEN CONCAT('plates/plates_', CAST(event_id AS STRING))
  ELSE CONCAT('banner/', CAST(event_id AS STRING)) END AS object_key
FROM {events} WHERE event_type IN ('view', 'click')""",
}


@cache
def _inputs(view: str) -> tuple[str, ...]:
    fields = (field for _, field, _, _ in string.Formatter().parse(VIEWS[view]) if field)
    return tuple(dict.fromkeys(fields))


def derive(
    spark: SparkSession, sf_dir: str, *names: str, **sources: DataFrame
) -> dict[str, DataFrame]:
    """The named views (all of them by default), lazily, over the test tables in ``sf_dir``.

    ``sources`` replaces tables or views of those names, for example by a stream. Without it the
    lazy plans (never data) are kept per session and folder.
    """
    built = dict(sources) if sources else _plans(spark, sf_dir)
    return {name: _build(spark, sf_dir, name, built) for name in names or VIEWS}


@cache
def _plans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {}


def _build(
    spark: SparkSession, sf_dir: str, name: str, built: dict[str, DataFrame]
) -> DataFrame:
    if name not in built:
        if name in VIEWS:
            inputs = {source: _build(spark, sf_dir, source, built) for source in _inputs(name)}
            built[name] = spark.sql(VIEWS[name], **inputs)
        else:
            built[name] = spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    return built[name]


def sql_for(name: str) -> str:
    """Text of one view over views of the same names."""
    return VIEWS[name].format(**{source: source for source in _inputs(name)}).strip()


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views and everything they read, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for source in _inputs(name):
                add(source)
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS (\n{sql_for(name)}\n)" for name in ordered)
