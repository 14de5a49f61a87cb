"""Edge rows of the searches: missing flags, wildcards, duplicate reactions, old prices, paging."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from numberboard.functions import predicates as P
from numberboard.operators import stores
from numberboard.operators.envelope import nest_page
from numberboard.operators.latest import plate_reactions
from numberboard.operators.joins import semi_filter
from numberboard.params import PlatesFilter, UsersFilter
from numberboard.plans import listings as L
from numberboard.plans import stores as S

PLATES = (
    "plates_id int, front_text string, back_number int, users_id int, is_selling boolean,"
    " is_temporary boolean, is_pin boolean, province_id int"
)
ROWS = [
    (1, "ก1", 60, 1, True, None, True, 1),
    (2, "ข%", 160, 1, True, False, None, 2),
    (3, "ก_", 6, 1, None, None, False, 1),  # not for sale: unknown
    (4, "กก", 600, 1, True, True, None, 1),  # temporary
    (5, "กข", 61, 9, True, None, None, 1),  # seller is gone
    (6, "กค", 62, 2, True, None, None, 1),  # no price
    (7, "กง", 63, 2, True, None, False, 1),  # only the old price is under the limit
]


@pytest.fixture(scope="module")
def tables(spark):
    extra = (
        "1 AS plates_type_id", "CAST(NULL AS STRING) AS plates_uri", "1 AS total",
        "TIMESTAMP_NTZ '2024-03-10 15:56:52.340800' + MAKE_INTERVAL(0, 0, 0, plates_id) AS add_date",
        "0 AS front_number", "1 AS vehicle_type_id", "1 AS special_front_id",
        "CAST(NULL AS STRING) AS information",
    )
    reactions = [(1, 5, 1), (2, 5, 1), (3, 6, 1)]
    return {
        "plates": spark.createDataFrame(ROWS, PLATES).selectExpr("*", *extra),
        "price_history": spark.createDataFrame(
            [(1, 1, 900), (2, 1, 100), (3, 2, 50), (4, 3, 50), (5, 4, 50), (6, 5, 50), (7, 7, 10), (8, 7, 999)],
            "price_history_id int, plates_id int, price int",
        ),
        "users": spark.createDataFrame(
            [(1, "one%", None, None, None), (2, "two", None, None, None)],
            "users_id int, name string, profile_uri string, cover_uri string, information string",
        ).selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_date"),
        "liked_plates": spark.createDataFrame(reactions, "liked_plates_id int, users_id int, plates_id int"),
        "saved_plates": spark.createDataFrame(
            [(1, 5, 1), (2, 7, 1)], "saved_plates_id int, users_id int, plates_id int"
        ),
        "liked_store": spark.createDataFrame([(1, 5, 1)], "liked_store_id int, users_id int, store_id int"),
        "saved_store": spark.createDataFrame([], "saved_store_id int, users_id int, store_id int"),
        "rating": spark.createDataFrame(
            [(1, 5, 1, 4.0), (2, 6, 1, 5.0)], "rating_id int, users_id int, store_id int, score double"
        ),
    }


BASE = PlatesFilter(price_under=100, plates_type_id_list=(1,), province_id_list=(1, 2))


def ids(df):
    return [row.plates_id for row in df.collect()]


def test_flags_prices_and_missing_sides(tables):
    # 3 and 4 are not sellable, 5 has no seller, 6 no price, 7 is above the limit now.
    assert sorted(ids(L.query_explore(tables, BASE))) == [1, 2]
    assert sorted(ids(L.query_explore(tables, replace(BASE, price_under=999)))) == [1, 2, 7]


def test_empty_lists_match_nothing(tables):
    assert ids(L.query_explore(tables, replace(BASE, province_id_list=()))) == []
    assert semi_filter(tables["plates"], "province_id", []).count() == 0
    assert semi_filter(tables["plates"], "province_id", range(2000)).count() == len(ROWS)


def test_text_is_literal_unless_wildcards_are_asked_for(tables):
    def found(text, wildcards=False):
        f = replace(BASE, price_under=999, search_text_front_text=text, wildcards=wildcards)
        return sorted(ids(L.search_text(tables, f)))

    assert found("") == [1, 2, 7]
    assert found("ข%") == [2]
    assert found("_") == []
    assert found("_", wildcards=True) == [1, 2, 7]
    assert found("ก' OR 1=1") == []

    def stores(text, wildcards=False):
        f = UsersFilter(search_text=text, wildcards=wildcards)
        return sorted(row.users_id for row in S.search_users_info(tables, f).collect())

    assert stores("%") == [1]
    assert stores("%", wildcards=True) == [1, 2]
    assert stores("") == [1, 2]


def test_duplicate_viewer_reactions_repeat_the_plate(tables):
    rows = [row for row in L.query_explore(tables, replace(BASE, users_id=5)).collect() if row.plates_id == 1]
    assert [(row.liked_plates_id, row.saved_plates_id, row.liked_store_id) for row in rows] == [(1, 1, 1), (2, 1, 1)]
    # three likes times two saves
    assert {(row.liked_plates_id_count, row.saved_plates_id_count, row.reacts_count) for row in rows} == {(6, 6, 12)}


def test_plain_counts(tables):
    rows = plate_reactions(tables["liked_plates"], tables["saved_plates"], "distinct").collect()
    assert [tuple(row) for row in rows] == [(1, 3, 2, 5)]
    with pytest.raises(ValueError):
        plate_reactions(tables["liked_plates"], tables["saved_plates"], "other")


def test_timestamp_text(tables):
    row = L.query_plates_info(tables, 0, 1).first()
    assert row.add_date == "2024-03-11 15:56:52.3408+00"


def test_pages_are_disjoint_and_complete(tables):
    f = replace(BASE, price_under=999, sort_by="priceHighToLow")
    whole = ids(L.query_explore(tables, f))
    assert whole == [7, 1, 2]
    pages = [ids(L.query_explore(tables, replace(f, limit=1, offset=n))) for n in range(4)]
    assert pages == [[7], [1], [2], []]


@pytest.mark.parametrize(
    ("mode", "expected"),
    [("priceLowToHigh", [2, 1, 7]), ("reacts", [1, 2, 7]), ("addDate", [7, 2, 1]), ("unknown", [7, 2, 1])],
)
def test_sort_modes(tables, mode, expected):
    assert ids(L.query_explore(tables, replace(BASE, price_under=999, sort_by=mode))) == expected


def test_random_order_repeats_for_a_seed(tables):
    f = replace(BASE, price_under=999, sort_by="random", seed=3)
    assert ids(L.query_explore(tables, f)) == ids(L.query_explore(tables, f))
    assert sorted(ids(L.query_explore(tables, f))) == [1, 2, 7]


def test_exact_and_suggestion_paged_and_nested(tables):
    f = replace(BASE, price_under=999, search_text_back_number=60)
    whole = L.search_number(tables, f)
    assert sorted((row.bucket, row.plates_id) for row in whole.collect()) == [
        ("exact", 1), ("suggestion", 1), ("suggestion", 2),
    ]
    paged = L.search_number(tables, replace(f, limit=1, sort_by="priceLowToHigh"))
    assert sorted((row.bucket, row.plates_id) for row in paged.collect()) == [("exact", 1), ("suggestion", 2)]
    nested = nest_page(paged).first()
    assert [len(nested.exact), len(nested.suggestion)] == [1, 1]


def test_unknown_pattern(tables):
    with pytest.raises(ValueError):
        L.query_pattern(tables, replace(BASE, pattern="users; DROP TABLE plates"))


def test_duplicate_memberships_repeat_plates(spark, tables):
    members = spark.createDataFrame([("pattern_x", 1), ("pattern_x", 1)], "pattern string, plates_id int")
    found = L.query_pattern({**tables, "plate_patterns": members}, replace(BASE, pattern="pattern_x"))
    assert ids(found) == [1, 1]


def test_pin_state_keeps_null_as_not_pinned(tables):
    assert ids(L.query_users_plates_pin(tables, UsersFilter(store_id=1))) == [1]
    assert ids(L.query_users_plates_unpin(tables, UsersFilter(store_id=1))) == [2]


def test_store_totals_fan_out(tables):
    row = S.query_users_info(tables, UsersFilter(users_id=5, store_id=1)).first()
    # two plates, two ratings, one like, no save
    assert (row.plates_count, row.liked_store_id_count, row.saved_store_id_count) == (4, 4, 0)
    assert (row.total_assets, row.average_score, row.liked_store_id) == (300, 4.5, 1)
    plain = S.query_users_info(tables, UsersFilter(store_id=1, counts="distinct")).first()
    assert (plain.plates_count, plain.liked_store_id_count, plain.total_assets) == (2, 1, 150)


def test_listing_repeats_rows_of_repeated_reactions(tables):
    f = replace(BASE, users_id=5, price_under=999, search_text_back_number=60)
    rows = [tuple(row) for row in L.search_number(tables, f).collect()]
    assert len(rows) == 5 and len({row[0] for row in rows}) == 2


def test_no_job_runs_while_a_plan_is_built(spark, tables):
    """Every listing and store plan is built without an action."""
    f = replace(BASE, users_id=5, price_under=999, search_text_back_number=60, search_text_front_text="ก")
    members = tables["plates"].select("plates_id", "add_date").withColumn("pattern", F.lit("pattern_9"))
    catalogue = {**tables, "plate_patterns": members}
    plans = [
        L.query_special_front, L.query_plates_type_province, L.query_vehicle_type_province, L.query_explore,
        L.query_suggestion_back_number, L.search_number_text_number, L.search_number_text, L.search_text_number,
        L.search_text, L.search_number,
    ]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "plans only")
    for plan in plans:
        plan(catalogue, f)
    L.query_pattern(catalogue, replace(f, pattern="pattern_9"))
    L.query_plates_info(catalogue, 5, 1)
    for plan in (L.query_users_plates_pin, L.query_users_plates_unpin, S.search_users_info, S.query_users_info):
        plan(catalogue, UsersFilter(users_id=5, store_id=1, search_text="o"))
    assert list(jobs.getJobIdsForGroup("planning")) == []
    spark.sparkContext.setJobGroup("tests", "")


def test_totals_of_a_store_with_millions_of_reactions(spark):
    """Products beyond 64 bits stay exact, beyond 38 digits they are null; other stores are not touched."""
    many = 3_000_000

    def reactions(name):
        hot = spark.range(many).select(F.col("id").cast("int").alias(name), F.lit(1).alias("store_id"))
        return hot.union(spark.createDataFrame([(-1, 2)], f"{name} int, store_id int"))

    rating = reactions("rating_id").withColumn("score", F.lit(4.0))
    liked, saved = reactions("liked_store_id"), reactions("saved_store_id")
    plates = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "plates_id int, users_id int")
    prices = spark.createDataFrame([(1, 1, 500), (2, 2, 700), (3, 3, 9)], "price_history_id int, plates_id int, price int")
    totals = {r.users_id: r for r in stores.store_totals(plates, prices, rating, liked, saved).collect()}
    assert totals[1].total_assets == 1200 * many**3 and totals[1].plates_count == 2 * many**3
    assert totals[1].reacts_count == 4 * many**3 and totals[1].liked_store_id_count == 2 * many**3
    assert (totals[2].total_assets, totals[2].plates_count, totals[2].reacts_count) == (9, 1, 2)
    by_store = {r.store_id: r for r in stores.store_reactions(rating, liked, saved).collect()}
    assert by_store[1].rating_id_count == many**3 and by_store[2].rating_id_count == 1
    narrow = {r.store_id: r for r in stores.narrowed(stores.store_reactions(rating, liked, saved)).collect()}
    assert narrow[1].rating_id_count is None and narrow[2].rating_id_count == 1 and narrow[1].average_score == 4.0
    wide = spark.createDataFrame([(1 << 62,)], "n long").select(stores.product(*[F.col("n")] * 3).alias("p")).first()
    assert wide.p is None


@pytest.mark.parametrize("number", [0, 7, 10, 12, 99, 123, 500, 1000, 9999, 12345, -12])
def test_substring_searches_skip_by_numbers(spark, tmp_path, number):
    """The listed numbers give the rows of a text search, also beyond four digits, and reach the scan."""
    numbers = [*range(10_000), 10_000, 12_345, 512_345, 99_999, -1, -12, -123, None]
    path = str(tmp_path / "numbers")
    spark.createDataFrame([(n,) for n in numbers], "back_number int").write.parquet(path)
    found = spark.read.parquet(path).where(P.back_number_contains(number))
    assert sorted(r.back_number for r in found.collect()) == sorted(n for n in numbers if n is not None and str(number) in str(n))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert ("Or(" in pushed) == (abs(number) >= 10)
