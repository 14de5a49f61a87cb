"""Independent SQL statements of every registered query, run by DuckDB on the same tables.

The Spark jobs avoid building fan-outs, global windows and full sorts; the statements here do build
them, so agreement shows that the shortcuts change no row. Classifier rules are stated on the digits
as text, where the Spark side uses arithmetic.
"""

from __future__ import annotations

from numberboard.functions.patterns import FRONT_TEXTS, LUCKY_NUMBERS, RUNS, SHAPES, TAILS
from numberboard.sources.fixtures import with_views

NOW = "TIMESTAMP '2024-06-01 00:00:00'"

LISTING_TABLES = (
    "plates", "price_history", "users", "liked_plates", "saved_plates", "liked_store", "saved_store",
)

LISTING_SELECT = """p.plates_id, p.front_text, p.plates_type_id, p.plates_uri, p.total,
 CAST(p.add_date AS STRING) || '+00' AS add_date, p.front_number, p.back_number, p.vehicle_type_id,
 p.users_id, p.special_front_id, p.province_id, p.information, c.price, u.name, u.profile_uri,
 vl.liked_plates_id, vs.saved_plates_id, sl.liked_store_id, ss.saved_store_id,
 c.liked_plates_id_count, c.saved_plates_id_count,
 c.liked_plates_id_count + c.saved_plates_id_count AS reacts_count, c.rownumber"""



def current(distinct: bool = False) -> str:
    """CTEs ending in ``current_price``: every like meets every save before they are counted."""
    once = "DISTINCT " if distinct else ""
    return f"""newest AS (
 SELECT h.plates_id, h.price, h.price_history_id,
  ROW_NUMBER() OVER (PARTITION BY h.plates_id ORDER BY h.price_history_id DESC) AS rownumber
 FROM price_history AS h
),
current_price AS (
 SELECT n.plates_id, n.price_history_id, n.price, n.rownumber,
  COUNT({once}l.liked_plates_id) AS liked_plates_id_count, COUNT({once}s.saved_plates_id) AS saved_plates_id_count
 FROM newest AS n
 LEFT JOIN liked_plates AS l ON l.plates_id = n.plates_id
 LEFT JOIN saved_plates AS s ON s.plates_id = n.plates_id
 WHERE n.rownumber = 1
 GROUP BY n.plates_id, n.price_history_id, n.price, n.rownumber
)"""


def listing_from(viewer: int) -> str:
    return f"""FROM plates AS p
 JOIN current_price AS c ON c.plates_id = p.plates_id
 JOIN users AS u ON u.users_id = p.users_id
 LEFT JOIN liked_plates AS vl ON vl.plates_id = p.plates_id AND vl.users_id = {viewer}
 LEFT JOIN saved_plates AS vs ON vs.plates_id = p.plates_id AND vs.users_id = {viewer}
 LEFT JOIN liked_store AS sl ON sl.store_id = p.users_id AND sl.users_id = {viewer}
 LEFT JOIN saved_store AS ss ON ss.store_id = p.users_id AND ss.users_id = {viewer}
WHERE p.is_selling IS TRUE AND p.is_temporary IS NOT TRUE"""


ORDERINGS = {
    "priceLowToHigh": "price ASC NULLS LAST",
    "priceHighToLow": "price DESC NULLS FIRST",
    "reacts": "reacts_count DESC NULLS FIRST",
    "addDate": "add_date DESC NULLS FIRST",
}
TIES = (
    "plates_id NULLS LAST, liked_plates_id NULLS LAST, saved_plates_id NULLS LAST, "
    "liked_store_id NULLS LAST, saved_store_id NULLS LAST"
)


def listing(
    viewer: int,
    where: str = "",
    price_under: int | None = None,
    ids: tuple[int, ...] | None = None,
    views: tuple[str, ...] = (),
    ctes: str = "",
    distinct: bool = False,
) -> str:
    """Unsorted listing; sorting does not change the set of rows."""
    if price_under is not None:
        where = f" AND c.price <= {price_under}{where}"
    if ids is not None:
        inside = ", ".join(map(str, ids))
        where = f" AND p.plates_type_id IN ({inside}) AND p.province_id IN ({inside}){where}"
    head = f"{with_views(*LISTING_TABLES, *views)},\n{current(distinct)}{ctes}"
    return f"{head}\nSELECT {LISTING_SELECT}\n{listing_from(viewer)}{where}"


def paged(sql: str, sort_by: str, limit: int, offset: int) -> str:
    return (
        f"SELECT * FROM (\n{sql}\n) AS rows_to_page\n"
        f"ORDER BY {ORDERINGS[sort_by]}, {TIES} LIMIT {limit} OFFSET {offset}"
    )


def both_lists(
    viewer: int,
    exact: str,
    suggestion: str,
    price_under: int,
    ids: tuple[int, ...],
    page: tuple[str, int, int] | None = None,
) -> str:
    """Exact and suggested list, each paged by ``page`` = (sort mode, limit, offset) if given."""
    inside = ", ".join(map(str, ids))
    common = (
        f" AND p.plates_type_id IN ({inside}) AND p.province_id IN ({inside})"
        f" AND c.price <= {price_under}"
    )
    parts = []
    for bucket, where in (("exact", exact), ("suggestion", suggestion)):
        part = f"SELECT {LISTING_SELECT}, '{bucket}' AS bucket\n{listing_from(viewer)}{common}{where}"
        parts.append(f"SELECT * FROM (\n{paged(part, *page)}\n) AS {bucket}_page" if page else part)
    return f"{with_views(*LISTING_TABLES)},\n{current()}\n" + "\nUNION ALL\n".join(parts)


# -- classifier --------------------------------------------------------------------------------

_LETTER_AT = {0: "a", 1: "b", 2: "c", 3: "d"}


def _shape_sql(name: str) -> str:
    parts = [f"LENGTH(s) = {len(name)}"]
    for right in range(len(name)):
        for left in range(right):
            sign = "=" if name[left] == name[right] else "<>"
            parts.append(f"{_LETTER_AT[left]} {sign} {_LETTER_AT[right]}")
    return " AND ".join(parts)


def _members_sql() -> str:
    lucky = ", ".join(f"'{number}'" for number in LUCKY_NUMBERS)
    rows = [f"SELECT plates_id, CONCAT('pattern_', s) AS pattern, add_date FROM digits WHERE s IN ({lucky})"]
    rules = {name: _shape_sql(name) for name in SHAPES}
    for name, step in RUNS.items():
        ladder = "123456789" if step > 0 else "987654321"
        rules[name] = f"LENGTH(s) = {len(name)} AND POSITION(s IN '{ladder}') > 0"
    for name in TAILS:
        rules[name] = f"s LIKE '_{name[1:]}'"
    for name, condition in rules.items():
        rows.append(f"SELECT plates_id, 'pattern_{name}', add_date FROM digits WHERE {condition}")
    for name, (text, match) in FRONT_TEXTS.items():
        like = f"LIKE '{text}%'" if match == "prefix" else f"= '{text}'"
        rows.append(
            f"SELECT plates_id, 'pattern_{name}', add_date FROM classified"
            f" WHERE front_number = 0 AND vehicle_type_id = 1 AND front_text {like}"
        )
    return "\nUNION ALL\n".join(rows)


def members(source: str) -> str:
    """CTEs ending in ``members`` for the plates of another CTE."""
    return f"""classified AS (SELECT * FROM {source}),
digits AS (
 SELECT plates_id, add_date, s, SUBSTR(s, 1, 1) AS a, SUBSTR(s, 2, 1) AS b, SUBSTR(s, 3, 1) AS c, SUBSTR(s, 4, 1) AS d
 FROM (SELECT plates_id, add_date, CAST(back_number AS STRING) AS s FROM classified
  WHERE back_number BETWEEN 1 AND 9999) AS numbers
),
members AS (
{_members_sql()}
)"""


# -- stores ------------------------------------------------------------------------------------


def stores(viewer: int, where: str) -> str:
    views = with_views("plates", "price_history", "users", "liked_store", "saved_store", "rating")
    return f"""{views},
newest AS (
 SELECT plates_id, price, ROW_NUMBER() OVER (PARTITION BY plates_id ORDER BY price_history_id DESC) AS place
 FROM price_history
)
SELECT u.users_id, u.name, CAST(u.created_date AS STRING) || '+00' AS created_date, u.profile_uri,
 u.cover_uri, u.information, vl.liked_store_id, vs.saved_store_id,
 COUNT(l.liked_store_id) AS liked_store_id_count, COUNT(s.saved_store_id) AS saved_store_id_count,
 COUNT(l.liked_store_id) + COUNT(s.saved_store_id) AS reacts_count,
 CAST(SUM(n.price) AS BIGINT) AS total_assets, COUNT(p.plates_id) AS plates_count,
 AVG(r.score) AS average_score
FROM users AS u
 JOIN plates AS p ON p.users_id = u.users_id AND p.is_selling IS TRUE AND p.is_temporary IS NOT TRUE
 JOIN newest AS n ON n.plates_id = p.plates_id AND n.place = 1
 LEFT JOIN liked_store AS vl ON vl.store_id = u.users_id AND vl.users_id = {viewer}
 LEFT JOIN saved_store AS vs ON vs.store_id = u.users_id AND vs.users_id = {viewer}
 LEFT JOIN rating AS r ON r.store_id = u.users_id
 LEFT JOIN liked_store AS l ON l.store_id = u.users_id
 LEFT JOIN saved_store AS s ON s.store_id = u.users_id
WHERE {where}
GROUP BY u.users_id, u.name, u.created_date, u.profile_uri, u.cover_uri, u.information,
 vl.liked_store_id, vs.saved_store_id"""


# -- changes -----------------------------------------------------------------------------------

DECIDED = """ranked AS (
 SELECT b.*, CONCAT('province_id(', CAST(b.province_id AS STRING), ')-vehicle_type_id(', CAST(b.vehicle_type_id AS STRING),
  ')-front_number(', CAST(b.front_number AS STRING), ')-front_text(', b.front_text, ')-back_number(', CAST(b.back_number AS STRING), ')') AS unique_text,
  ROW_NUMBER() OVER (PARTITION BY b.province_id, b.vehicle_type_id, b.front_number, b.front_text, b.back_number
   ORDER BY b.request_id) = 1 AND NOT EXISTS (
   SELECT 1 FROM plates AS p WHERE p.province_id = b.province_id AND p.vehicle_type_id = b.vehicle_type_id
    AND p.front_number = b.front_number AND p.front_text = b.front_text AND p.back_number = b.back_number) AS won
 FROM new_plates_batch AS b
),
decided AS (
 SELECT r.*, CASE WHEN won THEN (SELECT MAX(plates_id) FROM plates)
   + CAST(ROW_NUMBER() OVER (PARTITION BY won ORDER BY request_id) AS INT) END AS plates_id
 FROM ranked AS r
)"""


def admit_new_plates() -> str:
    return f"""{with_views('new_plates_batch', 'plates')},
{DECIDED}
SELECT plates_id, request_id, front_text, plates_type_id, total, front_number, back_number, vehicle_type_id,
 users_id, special_front_id, province_id, information, price, is_temporary, unique_text,
 CASE WHEN won THEN 'admitted' ELSE 'conflict' END AS status
FROM decided"""


def new_plate_prices() -> str:
    return f"""{with_views('new_plates_batch', 'plates', 'price_history')},
{DECIDED}
SELECT (SELECT MAX(price_history_id) FROM price_history)
  + CAST(ROW_NUMBER() OVER (ORDER BY plates_id) AS INT) AS price_history_id,
 plates_id, price, {NOW} AS add_date
FROM decided WHERE won AND NOT is_temporary"""


def new_plate_patterns() -> str:
    return f"""{with_views('new_plates_batch', 'plates')},
{DECIDED},
admitted AS (SELECT *, {NOW} AS add_date FROM decided WHERE won),
{members('admitted')}
SELECT plates_id, pattern, add_date FROM members"""


def _after_admission() -> str:
    """CTEs ending in ``grown_plates`` and ``grown_prices``: the tables with the admitted plates."""
    return f"""{with_views(*LISTING_TABLES, 'new_plates_batch')},
{DECIDED},
grown_plates AS (
 SELECT plates_id, front_text, plates_type_id, plates_uri, total, add_date, front_number, back_number, vehicle_type_id,
  users_id, special_front_id, province_id, information, is_selling, is_temporary, is_pin FROM plates
 UNION ALL
 SELECT plates_id, front_text, plates_type_id, CAST(NULL AS STRING), total, {NOW}, front_number, back_number, vehicle_type_id,
  users_id, special_front_id, province_id, information, TRUE, is_temporary, FALSE FROM decided WHERE won
),
grown_prices AS (
 SELECT price_history_id, plates_id, price FROM price_history
 UNION ALL
 SELECT (SELECT MAX(price_history_id) FROM price_history) + CAST(ROW_NUMBER() OVER (ORDER BY plates_id) AS INT), plates_id, price
 FROM decided WHERE won AND NOT is_temporary
)"""


def after_admission(price_under: int, ids: tuple[int, ...], pattern: str | None = None) -> str:
    """Listing, of one pattern if given, over the tables with the admitted plates."""
    inside = ", ".join(map(str, ids))
    where = f" AND c.price <= {price_under} AND p.plates_type_id IN ({inside}) AND p.province_id IN ({inside})"
    ctes = ""
    if pattern:
        ctes = ",\n" + members("plates")
        where += f" AND p.plates_id IN (SELECT plates_id FROM members WHERE pattern = '{pattern}')"
    shadowed = "WITH plates AS (SELECT * FROM grown_plates), price_history AS (SELECT * FROM grown_prices)"
    return f"{_after_admission()}\nSELECT * FROM (\n{shadowed},\n{current()}{ctes}\nSELECT {LISTING_SELECT}\n{listing_from(0)}{where}\n) AS found"


def pattern_counts_after_admission() -> str:
    return f"{_after_admission()},\n{members('grown_plates')}\nSELECT pattern, COUNT(*) AS members FROM members GROUP BY pattern"


def append_prices() -> str:
    return f"""{with_views('price_history', 'price_requests')},
extended AS (
 SELECT price_history_id, plates_id, price FROM price_history
 UNION ALL
 SELECT (SELECT MAX(price_history_id) FROM price_history) + CAST(ROW_NUMBER() OVER (ORDER BY request_id) AS INT),
  plates_id, price FROM price_requests
),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY plates_id ORDER BY price_history_id DESC) AS place FROM extended)
SELECT plates_id, price_history_id, price FROM placed WHERE place = 1"""


def edits(table: str, key: str, edit_view: str, fields: tuple[str, ...], rest: tuple[str, ...]) -> str:
    last = ",\n".join(
        f"last_{f} AS (SELECT {key}, {f} FROM (SELECT {key}, {f}, ROW_NUMBER() OVER (PARTITION BY {key}"
        f" ORDER BY request_id DESC) AS place FROM {edit_view} WHERE edits_{f}) AS e WHERE place = 1)"
        for f in fields
    )
    columns = ", ".join(
        [f"t.{name}" for name in rest]
        + [f"CASE WHEN n_{f}.{key} IS NOT NULL THEN n_{f}.{f} ELSE t.{f} END AS {f}" for f in fields]
    )
    joins = "\n".join(f"LEFT JOIN last_{f} AS n_{f} ON n_{f}.{key} = t.{key}" for f in fields)
    return f"{with_views(table, edit_view)},\n{last}\nSELECT {columns} FROM {table} AS t\n{joins}"


def capped_pins(cap: int = 30) -> str:
    return f"""{with_views('plates', 'pin_requests', 'unpin_requests')},
released AS (
 SELECT plates_id, CASE WHEN plates_id IN (SELECT plates_id FROM unpin_requests) THEN FALSE ELSE is_pin END AS is_pin
 FROM plates
),
ranked AS (
 SELECT plates_id, ROW_NUMBER() OVER (ORDER BY first_request) AS place
 FROM (SELECT r.plates_id, MIN(r.request_id) AS first_request FROM pin_requests AS r
  JOIN released AS p ON p.plates_id = r.plates_id AND p.is_pin IS NOT TRUE GROUP BY r.plates_id) AS firsts
)
SELECT plates_id, CASE WHEN plates_id IN (SELECT plates_id FROM ranked
  WHERE place <= {cap} - (SELECT COUNT(*) FROM released WHERE is_pin)) THEN TRUE ELSE is_pin END AS is_pin
FROM released"""


def fold_reactions(first_only: bool) -> str:
    survivors = f"""{with_views('reaction_log')},
survivors AS (
 SELECT event_id, users_id, plates_id, ts FROM reaction_log AS a
 WHERE op = 'add' AND NOT EXISTS (SELECT 1 FROM reaction_log AS r WHERE r.op = 'remove'
  AND r.users_id = a.users_id AND r.plates_id = a.plates_id AND r.event_id > a.event_id)
)"""
    if not first_only:
        return f"{survivors}\nSELECT event_id, users_id, plates_id, ts FROM survivors"
    return f"""{survivors}
SELECT event_id, users_id, plates_id, ts FROM (SELECT *, ROW_NUMBER() OVER (
 PARTITION BY users_id, plates_id ORDER BY event_id) AS place FROM survivors) AS s WHERE place = 1"""


ROUTED = """routed AS (
 SELECT request_id, id, object_key,
  CASE WHEN object_key LIKE '%profile/profile!_%' ESCAPE '!' THEN 'profile_uri'
   WHEN object_key LIKE '%cover/cover!_%' ESCAPE '!' THEN 'cover_uri'
   WHEN object_key LIKE '%plates/plates!_%' ESCAPE '!' THEN 'plates_uri' END AS field,
  CASE WHEN object_key NOT IN ('profile/profile_', 'cover/cover_', 'plates/plates_') THEN object_key END AS value
 FROM media_requests
),
placed AS (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY field, id ORDER BY request_id DESC) AS place FROM routed WHERE field IS NOT NULL
)"""


def media_users() -> str:
    return f"""{with_views('users', 'media_requests')},
{ROUTED}
SELECT u.users_id, CASE WHEN a.id IS NOT NULL THEN a.value ELSE u.profile_uri END AS profile_uri,
 CASE WHEN b.id IS NOT NULL THEN b.value ELSE u.cover_uri END AS cover_uri
FROM users AS u
LEFT JOIN placed AS a ON a.id = u.users_id AND a.field = 'profile_uri' AND a.place = 1
LEFT JOIN placed AS b ON b.id = u.users_id AND b.field = 'cover_uri' AND b.place = 1"""


def media_plates() -> str:
    return f"""{with_views('plates', 'media_requests')},
{ROUTED}
SELECT p.plates_id, CASE WHEN a.id IS NOT NULL THEN a.value ELSE p.plates_uri END AS plates_uri
FROM plates AS p
LEFT JOIN placed AS a ON a.id = p.plates_id AND a.field = 'plates_uri' AND a.place = 1"""


def media_replaced() -> str:
    return f"""{with_views('users', 'plates', 'media_requests')},
{ROUTED},
stored AS (
 SELECT 'profile_uri' AS field, users_id AS id, profile_uri AS value FROM users
 UNION ALL SELECT 'cover_uri', users_id, cover_uri FROM users
 UNION ALL SELECT 'plates_uri', plates_id, plates_uri FROM plates
),
before AS (
 SELECT p.field, p.id, CASE WHEN LAG(p.request_id) OVER w IS NULL THEN s.value ELSE LAG(p.value) OVER w END AS object_key
 FROM placed AS p JOIN stored AS s ON s.field = p.field AND s.id = p.id
 WINDOW w AS (PARTITION BY p.field, p.id ORDER BY p.request_id)
)
SELECT field, id, object_key FROM before WHERE object_key IS NOT NULL"""


def admit_plate_hashtags() -> str:
    return f"""{with_views('new_plates_hashtag', 'plates_hashtag')},
ranked AS (
 SELECT n.*, ROW_NUMBER() OVER (PARTITION BY plates_id, hashtag_id ORDER BY seq, add_date) AS place
 FROM new_plates_hashtag AS n
)
SELECT plates_id, hashtag_id, seq, add_date,
 CONCAT('plates_id(', CAST(plates_id AS STRING), ')-hashtag_id(', CAST(hashtag_id AS STRING), ')') AS unique_text
FROM ranked AS n WHERE place = 1 AND NOT EXISTS (
 SELECT 1 FROM plates_hashtag AS h WHERE h.plates_id = n.plates_id AND h.hashtag_id = n.hashtag_id)"""


def append_hashtags() -> str:
    return f"""{with_views('hashtag', 'hashtag_requests')}
SELECT hashtag_id, tag, add_date FROM hashtag
UNION ALL
SELECT (SELECT MAX(hashtag_id) FROM hashtag) + CAST(ROW_NUMBER() OVER (ORDER BY request_id) AS INT), tag,
 TIMESTAMP '2024-06-01 00:00:00' FROM hashtag_requests"""


def admitted_plates() -> str:
    return f"""SELECT plates_id, front_text, plates_type_id, CAST(NULL AS STRING) AS plates_uri, total,
 TIMESTAMP '2024-06-01 00:00:00' AS add_date, front_number, back_number, vehicle_type_id, users_id, special_front_id,
 province_id, information, TRUE AS is_selling, is_temporary, FALSE AS is_pin, unique_text
FROM (
{admit_new_plates()}
) AS decisions WHERE status = 'admitted'"""


def admitted_users() -> str:
    return f"""SELECT users_id, name, email, TIMESTAMP '2024-06-01 00:00:00' AS created_date,
 TIMESTAMP '2024-06-01 00:00:00' AS latest_sign_in, CAST(NULL AS STRING) AS profile_uri,
 CAST(NULL AS STRING) AS cover_uri, CAST(NULL AS STRING) AS information
FROM (
{admit_signups()}
) AS decisions WHERE status = 'admitted'"""


def admitted_plate_hashtags() -> str:
    return f"""SELECT (SELECT CAST(MAX(o_orderkey) AS INT) FROM orders)
 + CAST(ROW_NUMBER() OVER (ORDER BY plates_id, hashtag_id) AS INT) AS plates_hashtag_id,
 plates_id, hashtag_id, add_date, unique_text
FROM (
{admit_plate_hashtags()}
) AS admitted"""


def request_transfers() -> str:
    return f"""{with_views('transfer_plates', 'transfer_requests')}
SELECT transfer_plates_id, plates_id, users_id, store_id, add_date, received, received_date FROM transfer_plates
UNION ALL
SELECT (SELECT MAX(transfer_plates_id) FROM transfer_plates) + CAST(ROW_NUMBER() OVER (ORDER BY request_id) AS INT),
 plates_id, users_id, store_id, add_date, FALSE, CAST(NULL AS TIMESTAMP) FROM transfer_requests"""


def accept_transfers() -> str:
    return f"""{with_views('transfer_plates', 'accept_requests')},
placed AS (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY transfer_plates_id ORDER BY request_id DESC) AS place FROM accept_requests
),
last AS (SELECT transfer_plates_id, received_date AS at FROM placed WHERE place = 1)
SELECT t.transfer_plates_id, t.plates_id, t.users_id, t.store_id, t.add_date,
 t.received OR last.at IS NOT NULL AS received, COALESCE(last.at, t.received_date) AS received_date
FROM transfer_plates AS t LEFT JOIN last ON last.transfer_plates_id = t.transfer_plates_id"""


def apply_transfers() -> str:
    return f"""{with_views('plates', 'transfer_plates')},
placed AS (
 SELECT plates_id, store_id, ROW_NUMBER() OVER (PARTITION BY plates_id
  ORDER BY received_date DESC, transfer_plates_id DESC) AS place
 FROM transfer_plates WHERE received
)
SELECT p.plates_id, COALESCE(t.store_id, p.users_id) AS users_id
FROM plates AS p LEFT JOIN placed AS t ON t.plates_id = p.plates_id AND t.place = 1"""


def admit_signups() -> str:
    return f"""{with_views('signup_batch', 'users')},
cleaned AS (SELECT request_id, LOWER(TRIM(email)) AS email FROM signup_batch),
checked AS (
 SELECT *, email LIKE '_%@_%' AND email NOT LIKE '%@%@%' AND email NOT LIKE '% %' AS valid FROM cleaned
),
ranked AS (
 SELECT c.*, valid AND ROW_NUMBER() OVER (PARTITION BY valid, email ORDER BY request_id) = 1
  AND email NOT IN (SELECT email FROM users) AS won
 FROM checked AS c
)
SELECT request_id, email,
 CASE WHEN NOT valid THEN 'invalid' WHEN won THEN 'admitted' ELSE 'conflict' END AS status,
 CASE WHEN won THEN (SELECT MAX(users_id) FROM users)
  + CAST(ROW_NUMBER() OVER (PARTITION BY won ORDER BY request_id) AS INT) END AS users_id,
 CASE WHEN won THEN SPLIT_PART(email, '@', 1) END AS name
FROM ranked"""


def match_verifications() -> str:
    return f"""{with_views('verification', 'verification_attempt')},
fitting AS (
 SELECT a.attempt_id, a.verification_id, a.reference, a.code, a.attempt_ts, v.expire,
  ROW_NUMBER() OVER (PARTITION BY a.verification_id ORDER BY a.attempt_ts, a.attempt_id) AS place
 FROM verification_attempt AS a JOIN verification AS v ON v.verification_id = a.verification_id
  AND v.reference = a.reference AND v.code = a.code AND NOT v.verified AND v.expire > a.attempt_ts
)
SELECT attempt_id, verification_id, reference, code, attempt_ts, expire FROM fitting WHERE place = 1"""
