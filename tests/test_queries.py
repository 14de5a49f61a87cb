"""Every registered query against its SQL, and against the row counts of the fixtures."""

import os
import re

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Training-text operators have their own tests.
QUERIES = {name: query for name, query in queries().items() if name != "pipeline" and not re.match(r"op\d+_", name)}
SQL = {name: text for name, text in oracle_sql().items() if name in QUERIES}

# Rows at sf0.001; a query that silently returns nothing would otherwise agree with its SQL.
EXPECTED_ROWS = {
    "query_special_front": 230,
    "query_pattern": 21,
    "query_pattern_rakhang": 5,
    "query_plates_type_province": 7,
    "query_plates_type_other_provinces": 40,
    "query_vehicle_type_province": 134,
    "query_suggestion_back_number": 6,
    "query_explore": 314,
    "search_number_text_number": 2,
    "search_number_text": 41,
    "search_text_number": 4,
    "search_text": 85,
    "search_number": 6,
    "query_plates_info": 1,
    "search_users_info": 68,
    "query_users_info": 1,
    "query_users_plates_pin": 1,
    "query_users_plates_unpin": 5,
    "fetch_special_front": 24,
    "latest_price": 1473,
    "fold_reactions": 118,
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(df, duck, SQL[name]) is None
    if name in EXPECTED_ROWS and SF_DIR.endswith("sf0.001"):
        assert df.count() == EXPECTED_ROWS[name]


def test_entry(spark):
    assert entry(spark).count() == 314
