"""Registered queries: every operator over whole tables, and the SQL each is checked against."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles as sql  # noqa: E402
from numberboard.functions import predicates as P  # noqa: E402
from numberboard.functions.patterns import digit  # noqa: E402
from numberboard.functions.text import (  # noqa: E402
    clean_email,
    default_name,
    email_shape_ok,
    hashtag_identity,
    pg_timestamp_text,
    plate_identity,
)
from numberboard.operators import classify as C  # noqa: E402
from numberboard.operators.joins import semi_filter  # noqa: E402
from numberboard.operators.latest import (  # noqa: E402
    current_price,
    latest_by,
    latest_price,
    plate_reactions,
)
from numberboard.operators.stores import narrowed, store_reactions, store_totals  # noqa: E402
from numberboard.params import PlatesFilter, UsersFilter  # noqa: E402
from numberboard.plans import changes as W  # noqa: E402
from numberboard.plans import listings as L  # noqa: E402
from numberboard.plans import stores as S  # noqa: E402
from numberboard.session import tune  # noqa: E402
from numberboard.plans.publishing import MARKET, admit_and_publish  # noqa: E402
from numberboard.sources import tables as TB  # noqa: E402
from numberboard.sources.catalogue import Catalogue  # noqa: E402
from numberboard.sources.fixtures import SOURCE_SCHEMAS, derive, with_views  # noqa: E402
from numberboard.sources.workspace import workspace  # noqa: E402
from numberboard.streaming import jobs as ST  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
IDS = (1, 2, 3, 4, 5, 6, 7)
CEILING = 60_000
STORE = 52
PLATE = 203
VIEWERS = (0, 65)
BASE = PlatesFilter(
    price_under=CEILING,
    sort_by="priceLowToHigh",
    plates_type_id_list=IDS,
    province_id_list=IDS,
)
PAGE_LIMIT, PAGE_OFFSET = 50, 20


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")


def _listing(plan: Callable, f: PlatesFilter | UsersFilter) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(derive(spark, sf_dir, *sql.LISTING_TABLES), f)

    return run


def _on(*views: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Query over the named views, passed in order."""

    def wrap(plan: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = derive(spark, sf_dir, *views)
            return plan(*(tables[view] for view in views))

        return run

    return wrap


def _reads() -> dict[str, tuple[Query, str]]:
    entries: dict[str, tuple[Query, str]] = {}

    def search(name: str, plan: Callable, f: PlatesFilter, where: str) -> None:
        entries[name] = (_listing(plan, f), sql.listing(f.users_id, where, f.price_under, IDS))

    def search_both(name: str, plan: Callable, f: PlatesFilter, exact: str, suggestion: str) -> None:
        entries[name] = (
            _listing(plan, f),
            sql.both_lists(f.users_id, exact, suggestion, f.price_under, IDS),
        )

    search("query_special_front", L.query_special_front, BASE, " AND p.special_front_id <> 1")
    search(
        "query_plates_type_province",
        L.query_plates_type_province,
        replace(BASE, plates_type_id=2, province_id=1),
        " AND p.plates_type_id = 2 AND p.province_id = 1",
    )
    search(
        "query_plates_type_other_provinces",
        L.query_plates_type_province,
        replace(BASE, plates_type_id=2, province_id=0),
        " AND p.plates_type_id = 2 AND p.province_id <> 1",
    )
    search(
        "query_vehicle_type_province",
        L.query_vehicle_type_province,
        replace(BASE, vehicle_type_id=2, province_id=2),
        " AND p.vehicle_type_id = 2 AND p.province_id <> 0",
    )
    search_both(
        "query_suggestion_back_number",
        L.query_suggestion_back_number,
        replace(BASE, back_number=60),
        " AND p.back_number = 60",
        " AND CAST(p.back_number AS STRING) LIKE '%60%'",
    )
    for viewer in VIEWERS:
        suffix = "" if viewer == 0 else f"_viewer_{viewer}"
        search(f"query_explore{suffix}", L.query_explore, replace(BASE, users_id=viewer), "")

    search("query_explore_random", L.query_explore, replace(BASE, sort_by="random", seed=7), "")
    entries["query_explore_distinct"] = (
        _listing(L.query_explore, replace(BASE, counts="distinct")),
        sql.listing(0, "", CEILING, IDS, distinct=True),
    )

    text = replace(
        BASE, search_text_front_number=2, search_text_front_text="ก", search_text_back_number=60
    )
    contains = " AND CAST(p.back_number AS STRING) LIKE '%60%'"
    front, starts = " AND p.front_number = 2", " AND p.front_text LIKE 'ก%'"
    search_both(
        "search_number_text_number",
        L.search_number_text_number,
        text,
        f"{front}{starts} AND p.back_number = 60",
        f"{front}{starts}{contains}",
    )
    search("search_number_text", L.search_number_text, text, f"{front}{starts}")
    search_both(
        "search_text_number",
        L.search_text_number,
        text,
        f"{starts} AND p.back_number = 60",
        f"{starts}{contains}",
    )
    search(
        "search_text",
        L.search_text,
        replace(BASE, search_text_front_text="ฆ"),
        " AND p.front_text LIKE 'ฆ%'",
    )
    search_both("search_number", L.search_number, text, " AND p.back_number = 60", contains)

    entries["page_search_number"] = (
        _listing(L.search_number, replace(text, limit=20, offset=5, sort_by="priceHighToLow")),
        sql.both_lists(
            0, " AND p.back_number = 60", contains, CEILING, IDS, ("priceHighToLow", 20, 5)
        ),
    )

    def by_pattern(pattern: str) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables, root = derive(spark, sf_dir, *sql.LISTING_TABLES), workspace(spark, "plate_patterns")
            W.rebuild_patterns(tables["plates"], root, _now())
            tables["plate_patterns"] = TB.pattern_members(spark, root, pattern)
            return L.query_pattern(tables, replace(BASE, pattern=pattern))

        return run

    for name in ("xyx", "rakhang", "xxxx"):
        pattern = f"pattern_{name}"
        key = "query_pattern" if name == "xyx" else f"query_pattern_{name}"
        entries[key] = (
            by_pattern(pattern),
            sql.listing(
                0,
                f" AND p.plates_id IN (SELECT plates_id FROM members WHERE pattern = '{pattern}')",
                CEILING,
                IDS,
                ctes=",\n" + sql.members("plates"),
            ),
        )

    def info(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.query_plates_info(derive(spark, sf_dir, *sql.LISTING_TABLES), 0, PLATE)

    entries["query_plates_info"] = (info, sql.listing(0, f" AND p.plates_id = {PLATE}"))
    entries["query_users_plates_pin"] = (
        _listing(L.query_users_plates_pin, UsersFilter(store_id=STORE)),
        sql.listing(0, f" AND p.users_id = {STORE} AND p.is_pin IS TRUE"),
    )
    entries["query_users_plates_unpin"] = (
        _listing(L.query_users_plates_unpin, UsersFilter(store_id=STORE)),
        sql.listing(0, f" AND p.users_id = {STORE} AND p.is_pin IS NOT TRUE"),
    )

    # Pages: the limit is the feature.
    modes = tuple(sql.ORDERINGS)
    paged = replace(BASE, limit=PAGE_LIMIT, offset=PAGE_OFFSET)
    explore = sql.listing(0, "", CEILING, IDS)
    entries["page_explore"] = (
        _listing(L.query_explore, replace(paged, sort_by="reacts")),
        sql.paged(explore, "reacts", PAGE_LIMIT, PAGE_OFFSET),
    )
    entries["sort_modes"] = (
        _listing(lambda tables, f: L.sort_modes(tables, f, modes), paged),
        "\nUNION ALL\n".join(
            f"SELECT *, '{mode}' AS sort_by FROM (\n{sql.paged(explore, mode, PAGE_LIMIT, PAGE_OFFSET)}\n) AS {mode}_page"
            for mode in modes
        ),
    )

    def store_query(plan: Callable, f: UsersFilter) -> Query:
        views = ("plates", "price_history", "users", "liked_store", "saved_store", "rating")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(derive(spark, sf_dir, *views), f)

        return run

    entries["search_users_info"] = (
        store_query(lambda t, f: narrowed(S.search_users_info(t, f)), UsersFilter(users_id=8, search_text="1")),
        sql.stores(8, "u.name LIKE '%1%'"),
    )
    entries["query_users_info"] = (
        store_query(lambda t, f: narrowed(S.query_users_info(t, f)), UsersFilter(store_id=STORE)),
        sql.stores(0, f"u.users_id = {STORE}"),
    )
    entries["fetch_special_front"] = (
        _on("special_front")(S.fetch_special_front),
        f"{with_views('special_front')}\nSELECT special_front_id, front FROM special_front"
        " WHERE special_front_id <> (SELECT MIN(special_front_id) FROM special_front)",
    )
    entries["fetch_profile"] = (
        _on("users")(lambda users: S.fetch_profile(users, STORE)),
        f"{with_views('users')}\nSELECT name, email, profile_uri, cover_uri, information"
        f" FROM users WHERE users_id = {STORE}",
    )
    return entries


def _operators() -> dict[str, tuple[Query, str]]:
    inside = ", ".join(map(str, IDS))
    price_views = ("price_history", "liked_plates", "saved_plates")
    counts = "COUNT(l.liked_plates_id) AS liked_plates_id_count, COUNT(s.saved_plates_id) AS saved_plates_id_count"
    plain = (
        "SELECT plates_id, SUM(a) AS a, SUM(b) AS b FROM ("
        "SELECT plates_id, 1 AS a, 0 AS b FROM liked_plates UNION ALL SELECT plates_id, 0, 1 FROM saved_plates"
        ") AS rows_of_both GROUP BY plates_id"
    )
    return {
        "latest_price": (
            _on(*price_views)(latest_price),
            f"{with_views(*price_views)},\n{sql.current()}\nSELECT plates_id, price_history_id, price,"
            " liked_plates_id_count, saved_plates_id_count,"
            " liked_plates_id_count + saved_plates_id_count AS reacts_count, rownumber FROM current_price",
        ),
        "latest_price_rows": (
            _on("price_history")(lambda h: latest_by(h, "plates_id", "price_history_id")),
            f"{with_views('price_history')}\nSELECT price_history_id, plates_id, price, add_date FROM ("
            "SELECT *, ROW_NUMBER() OVER (PARTITION BY plates_id ORDER BY price_history_id DESC) AS place"
            " FROM price_history) AS h WHERE place = 1",
        ),
        "plate_reactions": (
            _on("liked_plates", "saved_plates")(plate_reactions),
            f"""{with_views('liked_plates', 'saved_plates')},
targets AS (SELECT plates_id FROM liked_plates UNION SELECT plates_id FROM saved_plates)
SELECT t.plates_id, {counts}, COUNT(l.liked_plates_id) + COUNT(s.saved_plates_id) AS reacts_count
FROM targets AS t LEFT JOIN liked_plates AS l ON l.plates_id = t.plates_id
LEFT JOIN saved_plates AS s ON s.plates_id = t.plates_id GROUP BY t.plates_id""",
        ),
        "plate_reactions_distinct": (
            _on("liked_plates", "saved_plates")(lambda l, s: plate_reactions(l, s, "distinct")),
            f"""{with_views('liked_plates', 'saved_plates')}
SELECT plates_id, CAST(a AS BIGINT) AS liked_plates_id_count, CAST(b AS BIGINT) AS saved_plates_id_count,
 CAST(a + b AS BIGINT) AS reacts_count FROM ({plain}) AS sums""",
        ),
        "store_reactions": (
            _on("rating", "liked_store", "saved_store")(lambda r, l, s: narrowed(store_reactions(r, l, s))),
            f"""{with_views('rating', 'liked_store', 'saved_store')},
targets AS (SELECT store_id FROM rating UNION SELECT store_id FROM liked_store UNION SELECT store_id FROM saved_store)
SELECT t.store_id, COUNT(r.rating_id) AS rating_id_count, COUNT(l.liked_store_id) AS liked_store_id_count,
 COUNT(s.saved_store_id) AS saved_store_id_count, AVG(r.score) AS average_score
FROM targets AS t LEFT JOIN rating AS r ON r.store_id = t.store_id
LEFT JOIN liked_store AS l ON l.store_id = t.store_id
LEFT JOIN saved_store AS s ON s.store_id = t.store_id GROUP BY t.store_id""",
        ),
        "store_totals": (
            _on("plates", "price_history", "rating", "liked_store", "saved_store")(
                lambda p, h, r, l, s: store_totals(p.where(P.is_sellable()), h, r, l, s, "distinct")
            ),
            f"""{with_views('plates', 'price_history', 'rating', 'liked_store', 'saved_store')},
newest AS (SELECT plates_id, price, ROW_NUMBER() OVER (PARTITION BY plates_id ORDER BY price_history_id DESC) AS place
 FROM price_history),
per_seller AS (SELECT p.users_id, COUNT(*) AS plates_count, CAST(SUM(n.price) AS BIGINT) AS total_assets
 FROM plates AS p JOIN newest AS n ON n.plates_id = p.plates_id AND n.place = 1
 WHERE p.is_selling IS TRUE AND p.is_temporary IS NOT TRUE GROUP BY p.users_id)
SELECT t.users_id,
 (SELECT COUNT(*) FROM liked_store AS l WHERE l.store_id = t.users_id) AS liked_store_id_count,
 (SELECT COUNT(*) FROM saved_store AS s WHERE s.store_id = t.users_id) AS saved_store_id_count,
 (SELECT COUNT(*) FROM liked_store AS l WHERE l.store_id = t.users_id)
  + (SELECT COUNT(*) FROM saved_store AS s WHERE s.store_id = t.users_id) AS reacts_count,
 t.total_assets, t.plates_count,
 (SELECT AVG(score) FROM rating AS r WHERE r.store_id = t.users_id) AS average_score
FROM per_seller AS t""",
        ),
        "pinned_count": (
            _on("plates")(W.pinned_count),
            f"{with_views('plates')}\nSELECT COUNT(*) AS pinned FROM plates WHERE is_pin IS TRUE",
        ),
        "semi_filter": (
            _on("plates")(
                lambda p: semi_filter(semi_filter(p, "plates_type_id", IDS), "province_id", IDS).select(
                    "plates_id", "plates_type_id", "province_id"
                )
            ),
            f"{with_views('plates')}\nSELECT plates_id, plates_type_id, province_id FROM plates"
            f" WHERE plates_type_id IN ({inside}) AND province_id IN ({inside})",
        ),
        "flag_filters": (
            _on("plates")(
                lambda p: p.select(
                    "plates_id",
                    P.is_sellable().alias("sellable"),
                    P.pinned().alias("pinned"),
                    P.not_pinned().alias("not_pinned"),
                )
            ),
            f"{with_views('plates')}\nSELECT plates_id, is_selling IS TRUE AND is_temporary IS NOT TRUE AS sellable,"
            " is_pin IS TRUE AS pinned, is_pin IS NOT TRUE AS not_pinned FROM plates",
        ),
        "plate_texts": (
            _on("plates")(
                lambda p: p.select(
                    "plates_id", plate_identity().alias("unique_text"),
                    pg_timestamp_text("add_date").alias("add_date"),
                    *[digit("back_number", power).alias(f"digit_{power}") for power in range(4)],
                )
            ),
            f"""{with_views('plates')}
SELECT plates_id, CONCAT('province_id(', province_id, ')-vehicle_type_id(', vehicle_type_id, ')-front_number(',
 front_number, ')-front_text(', front_text, ')-back_number(', back_number, ')') AS unique_text,
 CAST(add_date AS STRING) || '+00' AS add_date,
 CAST(SUBSTR(digits, 4, 1) AS INT) AS digit_0, CAST(SUBSTR(digits, 3, 1) AS INT) AS digit_1,
 CAST(SUBSTR(digits, 2, 1) AS INT) AS digit_2, CAST(SUBSTR(digits, 1, 1) AS INT) AS digit_3
FROM (SELECT *, LPAD(CAST(back_number AS STRING), 4, '0') AS digits FROM plates) AS p""",
        ),
        "hashtag_texts": (
            _on("new_plates_hashtag")(
                lambda n: n.select("plates_id", "hashtag_id", "seq", hashtag_identity().alias("unique_text"))
            ),
            f"{with_views('new_plates_hashtag')}\nSELECT plates_id, hashtag_id, seq,"
            " CONCAT('plates_id(', plates_id, ')-hashtag_id(', hashtag_id, ')') AS unique_text FROM new_plates_hashtag",
        ),
        "event_time_texts": (
            _on("liked_plates")(
                lambda l: l.select("liked_plates_id", pg_timestamp_text("add_date").alias("add_date"))
            ),
            f"{with_views('liked_plates')}\nSELECT liked_plates_id,"
            " RTRIM(RTRIM(STRFTIME(add_date, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') || '+00' AS add_date FROM liked_plates",
        ),
        "email_texts": (
            _on("signup_batch")(
                lambda b: b.select(
                    "request_id",
                    clean_email("email").alias("email"),
                    email_shape_ok(clean_email("email")).alias("valid"),
                    default_name(clean_email("email")).alias("name"),
                )
            ),
            f"{with_views('signup_batch')}\nSELECT request_id, LOWER(TRIM(email)) AS email,"
            " REGEXP_MATCHES(LOWER(TRIM(email)), '^[a-z0-9.]+@[a-z0-9]+([.][a-z0-9]+)*$') AS valid,"
            " SPLIT_PART(LOWER(TRIM(email)), '@', 1) AS name FROM signup_batch",
        ),
        "classify_plates": (
            _on("plates")(C.classify),
            f"{with_views('plates')},\n{sql.members('plates')}\nSELECT plates_id, pattern, add_date FROM members",
        ),
        "pattern_counts": (
            _on("plates")(lambda p: C.pattern_counts(C.classify(p))),
            f"{with_views('plates')},\n{sql.members('plates')}\n"
            "SELECT pattern, COUNT(*) AS members FROM members GROUP BY pattern",
        ),
    }


def _tables() -> dict[str, tuple[Query, str]]:
    """Queries that write a table and read it back."""

    def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = workspace(spark, "plate_patterns")
        W.rebuild_patterns(derive(spark, sf_dir, "plates")["plates"], path, _now())
        return TB.current(spark, path, "plate_patterns")

    def stored_members(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = workspace(spark, "plate_patterns")
        W.rebuild_patterns(derive(spark, sf_dir, "plates")["plates"], path, _now())
        return TB.pattern_members(spark, path, "pattern_rakhang")

    def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = workspace(spark, "tables")
        names = ("plates", "price_history")
        for name, table in derive(spark, sf_dir, *names).items():
            TB.append(table, f"{path}/{name}")
        tables = TB.load_tables(spark, path, names)
        return tables["price_history"].join(tables["plates"].select("plates_id", "users_id"), "plates_id")

    def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = workspace(spark, "price_history")
        tables = derive(spark, sf_dir, "price_history", "price_requests")
        TB.append(tables["price_history"], path)
        stored = spark.read.schema(TB.SCHEMAS["price_history"]).parquet(path)
        grown = W.append_prices(stored, tables["price_requests"], _now())
        root = workspace(spark, "grown")
        TB.publish(grown, root)
        return current_price(TB.current(spark, root, "price_history"))

    def published(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = workspace(spark, "plates")
        tables = derive(spark, sf_dir, "plates", "delete_requests", "plate_edits")
        TB.publish(tables["plates"], root)
        kept = W.delete_rows(TB.current(spark, root, "plates"), "plates_id", tables["delete_requests"])
        TB.publish(kept, root)
        return TB.current(spark, root, "plates").select("plates_id", "total", "is_selling")

    def market(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
        """The tables after a batch of new plates was admitted and published."""
        tables = derive(spark, sf_dir, *sql.LISTING_TABLES, "new_plates_batch")
        catalogue = Catalogue(spark, workspace(spark, "market"))
        loaded = {"plates": tables["plates"], "price_history": tables["price_history"], "plate_patterns": C.classify(tables["plates"])}
        first = catalogue.commit(catalogue.snapshot(), replaced=loaded)
        latest, _ = admit_and_publish(catalogue, tables["new_plates_batch"], _now(), first)
        return {**tables, **{name: catalogue.table(name, latest) for name in MARKET}}

    def admitted_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.query_explore(market(spark, sf_dir), BASE)

    def admitted_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.query_pattern(market(spark, sf_dir), replace(BASE, pattern="pattern_xyx"))

    def admitted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.pattern_counts(market(spark, sf_dir)["plate_patterns"])

    member_sql = f"{with_views('plates')},\n{sql.members('plates')}\nSELECT plates_id, pattern, TIMESTAMP '2024-06-01 00:00:00' AS add_date FROM members"
    return {
        "rebuild_patterns": (rebuild, member_sql),
        "pattern_members": (stored_members, f"{member_sql} WHERE pattern = 'pattern_rakhang'"),
        "publish_admitted_explore": (admitted_explore, sql.after_admission(CEILING, IDS)),
        "publish_admitted_pattern": (admitted_pattern, sql.after_admission(CEILING, IDS, "pattern_xyx")),
        "publish_admitted_pattern_counts": (admitted_counts, sql.pattern_counts_after_admission()),
        "load_tables": (
            loaded,
            f"{with_views('plates', 'price_history')}\nSELECT h.plates_id, h.price_history_id, h.price, h.add_date,"
            " p.users_id FROM price_history AS h JOIN plates AS p ON p.plates_id = h.plates_id",
        ),
        "append_and_publish_prices": (appended, sql.append_prices()),
        "publish_deletes": (
            published,
            f"{with_views('plates', 'delete_requests')}\nSELECT plates_id, total, is_selling FROM plates"
            " WHERE plates_id NOT IN (SELECT plates_id FROM delete_requests)",
        ),
    }


def _changes() -> dict[str, tuple[Query, str]]:
    plate_fields = ("information", "is_selling", "total")
    user_fields = ("name", "information", "latest_sign_in")
    return {
        "admit_new_plates": (
            _on("new_plates_batch", "plates")(W.admit_new_plates),
            sql.admit_new_plates(),
        ),
        "new_plate_prices": (
            _on("new_plates_batch", "plates", "price_history")(
                lambda b, p, h: W.new_plate_prices(W.admit_new_plates(b, p), h, _now())
            ),
            sql.new_plate_prices(),
        ),
        "new_plate_patterns": (
            _on("new_plates_batch", "plates")(
                lambda b, p: W.new_plate_patterns(W.admit_new_plates(b, p), _now())
            ),
            sql.new_plate_patterns(),
        ),
        "append_prices": (
            _on("price_history", "price_requests")(
                lambda h, r: current_price(W.append_prices(h, r, _now()))
            ),
            sql.append_prices(),
        ),
        "apply_field_edits": (
            _on("plates", "plate_edits")(
                lambda p, e: W.apply_field_edits(p, "plates_id", e, plate_fields).select(
                    "plates_id", *plate_fields
                )
            ),
            sql.edits("plates", "plates_id", "plate_edits", plate_fields, ("plates_id",)),
        ),
        "apply_user_edits": (
            _on("users", "user_edits")(
                lambda u, e: W.apply_field_edits(
                    u.withColumn("latest_sign_in", F.col("latest_sign_in").cast("timestamp_ntz")),
                    "users_id", e, user_fields,
                ).select("users_id", "email", *user_fields)
            ),
            sql.edits("users", "users_id", "user_edits", user_fields, ("users_id", "email")),
        ),
        "capped_pins": (
            _on("plates", "pin_requests", "unpin_requests")(
                lambda p, r, u: W.capped_pins(p, r, u).select("plates_id", "is_pin")
            ),
            sql.capped_pins(),
        ),
        "fold_reactions": (
            _on("reaction_log")(W.fold_reactions),
            sql.fold_reactions(first_only=False),
        ),
        "fold_reactions_set": (
            _on("reaction_log")(lambda log: W.fold_reactions(log, mode="set")),
            sql.fold_reactions(first_only=True),
        ),
        "fold_store_reactions": (
            _on("reaction_log")(
                lambda log: W.fold_reactions(
                    log.withColumnRenamed("plates_id", "store_id"), target="store_id"
                )
            ),
            "SELECT event_id, users_id, plates_id AS store_id, ts FROM (\n"
            f"{sql.fold_reactions(first_only=False)}\n) AS folded",
        ),
        "delete_rows": (
            _on("plates", "delete_requests")(
                lambda p, d: W.delete_rows(p, "plates_id", d).select("plates_id", "users_id")
            ),
            f"{with_views('plates', 'delete_requests')}\nSELECT plates_id, users_id FROM plates"
            " WHERE plates_id NOT IN (SELECT plates_id FROM delete_requests)",
        ),
        "apply_media_updates": (
            _on("users", "media_requests")(
                lambda u, r: W.apply_media_updates(u, "users_id", r).select(
                    "users_id", "profile_uri", "cover_uri"
                )
            ),
            sql.media_users(),
        ),
        "apply_media_updates_plates": (
            _on("plates", "media_requests")(
                lambda p, r: W.apply_media_updates(p, "plates_id", r).select("plates_id", "plates_uri")
            ),
            sql.media_plates(),
        ),
        "replaced_media": (
            _on("users", "plates", "media_requests")(W.replaced_media),
            sql.media_replaced(),
        ),
        "admit_plate_hashtags": (
            _on("new_plates_hashtag", "plates_hashtag")(W.admit_plate_hashtags),
            sql.admit_plate_hashtags(),
        ),
        "admitted_plate_hashtags": (
            _on("new_plates_hashtag", "plates_hashtag")(W.admitted_plate_hashtags),
            sql.admitted_plate_hashtags(),
        ),
        "append_hashtags": (
            _on("hashtag", "hashtag_requests")(lambda h, r: W.append_hashtags(h, r, _now())),
            sql.append_hashtags(),
        ),
        "request_transfers": (
            _on("transfer_plates", "transfer_requests")(W.request_transfers),
            sql.request_transfers(),
        ),
        "accept_transfers": (
            _on("transfer_plates", "accept_requests")(W.accept_transfers),
            sql.accept_transfers(),
        ),
        "apply_transfers": (
            _on("plates", "transfer_plates")(
                lambda p, t: W.apply_transfers(p, t).select("plates_id", "users_id")
            ),
            sql.apply_transfers(),
        ),
        "admit_signups": (_on("signup_batch", "users")(W.admit_signups), sql.admit_signups()),
        "admitted_users": (
            _on("signup_batch", "users")(lambda b, u: W.admitted_users(W.admit_signups(b, u), _now())),
            sql.admitted_users(),
        ),
        "admitted_plates": (
            _on("new_plates_batch", "plates")(lambda b, p: W.admitted_plates(W.admit_new_plates(b, p), _now())),
            sql.admitted_plates(),
        ),
        "match_verifications": (
            _on("verification_attempt", "verification")(W.match_verifications),
            sql.match_verifications(),
        ),
    }


def _streams() -> dict[str, tuple[Query, str]]:
    def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
        return ST.read_stream(spark, sf_dir, SOURCE_SCHEMAS[table], files=f"{table}.parquet")

    def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = workspace(spark, "stream_classify")
        orders = source(spark, sf_dir, "orders")
        plates = derive(spark, sf_dir, "plates", orders=orders)["plates"]
        members = ST.stream_classify(plates)
        ST.run_to_table(members, f"{out}/members", f"{out}/checkpoint")
        return spark.read.schema(members.schema).parquet(f"{out}/members")

    def admit(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = workspace(spark, "stream_admit")
        plates = derive(spark, sf_dir, "plates")["plates"]
        orders = source(spark, sf_dir, "orders")
        batch = derive(spark, sf_dir, "new_plates_batch", orders=orders)["new_plates_batch"]
        ST.stream_admit(batch, plates, f"{out}/decisions", f"{out}/checkpoint")
        schema = W.admit_new_plates(derive(spark, sf_dir, "new_plates_batch")["new_plates_batch"], plates).schema
        return ST.read_epochs(spark, f"{out}/decisions", schema).drop("epoch")

    def admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, inbox = workspace(spark, "stream_admit"), workspace(spark, "arrivals")
        tables = derive(spark, sf_dir, "plates", "new_plates_batch")
        batch, plates = tables["new_plates_batch"], tables["plates"]
        for _ in ST.arrivals(batch, "request_id", inbox):
            stream = ST.read_stream(spark, inbox, batch.schema)
            ST.stream_admit(stream, plates, f"{out}/decisions", f"{out}/checkpoint", fan=2)
        return ST.read_epochs(spark, f"{out}/decisions", W.admit_new_plates(batch, plates).schema).drop("epoch")

    def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, inbox = workspace(spark, "stream_latest_price"), workspace(spark, "arrivals")
        prices = derive(spark, sf_dir, "price_rows")["price_rows"]
        for _ in ST.arrivals(prices, "price", inbox):
            ST.run_latest_price(ST.read_stream(spark, inbox, prices.schema), f"{out}/changes", f"{out}/checkpoint", fan=2)
        return ST.read_latest_price(spark, f"{out}/changes", fan=2)

    def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = workspace(spark, "stream_latest_price")
        lineitem = source(spark, sf_dir, "lineitem")
        prices = derive(spark, sf_dir, "price_rows", lineitem=lineitem)["price_rows"]
        ST.run_latest_price(prices, f"{out}/changes", f"{out}/checkpoint")
        return ST.read_latest_price(spark, f"{out}/changes")

    newest_price = (
        f"{with_views('price_history')}\nSELECT plates_id, price_history_id, price FROM ("
        "SELECT *, ROW_NUMBER() OVER (PARTITION BY plates_id ORDER BY price_history_id DESC) AS place"
        " FROM price_history) AS h WHERE place = 1"
    )
    return {
        "stream_classify": (
            classify,
            f"{with_views('plates')},\n{sql.members('plates')}\nSELECT plates_id, pattern, add_date FROM members",
        ),
        "stream_admit": (admit, sql.admit_new_plates()),
        "stream_admit_files": (admit_files, sql.admit_new_plates()),
        "stream_latest_price": (latest, newest_price),
        "stream_latest_price_files": (latest_files, newest_price),
    }


def _training_text() -> dict[str, tuple[Query, str | None]]:
    """Operators on training text and their pipeline, where that subpackage is installed."""
    try:
        from corpus_pipeline import ORACLE_SQL, run
        from numberboard.llm import registry
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "numberboard.llm"):
            raise
        return {}
    return {**registry.QUERIES, "pipeline": (run, ORACLE_SQL)}


def _catalogue() -> dict[str, tuple[Query, str]]:
    return {**_reads(), **_operators(), **_tables(), **_changes(), **_streams()}


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**_catalogue(), **_training_text()}


def _tuned(query: Query, catalogue: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark, catalogue), sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: explore the catalogue of the smallest test tables."""
    return queries()["query_explore"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    """One entry per operator, each over whole tables."""
    catalogue = _catalogue()
    return {name: _tuned(query, name in catalogue) for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    """The SQL every query is checked against."""
    return {name: text for name, (_, text) in _all().items() if text is not None}
