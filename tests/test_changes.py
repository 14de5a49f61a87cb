"""Batch jobs against plain loops that handle one request after the other."""

import re

import pytest
from pyspark.sql import functions as F

from numberboard.functions.text import PLATE_IDENTITY, clean_email, email_shape_ok
from numberboard.operators.numbering import number_rows
from numberboard.plans import changes as W
from numberboard.sources.fixtures import derive

SF_DIR = "/root/testdata/sf0.001"


def now():
    return F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")


def by_key(rows, key):
    return {row[key]: row for row in rows}


@pytest.fixture(scope="module")
def views(spark):
    return derive(spark, SF_DIR)


def test_admission_in_request_order(views):
    plates, batch = views["plates"], views["new_plates_batch"]
    taken = {tuple(row) for row in plates.select(*PLATE_IDENTITY).collect()}
    next_id = max(row.plates_id for row in plates.select("plates_id").collect()) + 1
    expected = {}
    for row in sorted(batch.collect(), key=lambda row: row.request_id):
        identity = tuple(row[name] for name in PLATE_IDENTITY)
        if identity in taken:
            expected[row.request_id] = ("conflict", None)
        else:
            taken.add(identity)
            expected[row.request_id] = ("admitted", next_id)
            next_id += 1
    got = W.admit_new_plates(batch, plates).collect()
    assert {row.request_id: (row.status, row.plates_id) for row in got} == expected
    assert {status for status, _ in expected.values()} == {"admitted", "conflict"}


def test_admission_reuses_one_partitioning(spark, views):
    """Beyond broadcast size both sides are shuffled once, by the same keys in the same order."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        claims = W.first_claims(views["new_plates_batch"], views["plates"], PLATE_IDENTITY, "request_id")
        plan = claims._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert len(exchanges) == 3  # the batch twice (reused at run time) and the table
    assert len({re.sub(r"#\d+", "", keys) for keys in exchanges}) == 1


def test_admitted_plates_can_be_listed(views):
    decisions = W.admit_new_plates(views["new_plates_batch"], views["plates"])
    added = W.admitted_plates(decisions, now())
    assert added.columns == views["plates"].columns
    assert added.count() == decisions.where("status = 'admitted'").count()
    prices = W.new_plate_prices(decisions, views["price_history"], now())
    assert prices.count() == decisions.where("status = 'admitted' AND NOT is_temporary").count()
    assert prices.select("price_history_id").distinct().count() == prices.count()


@pytest.mark.parametrize("mode", ["rows", "set"])
@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_reactions_one_by_one(views, mode, hot_rows):
    log = views["reaction_log"]
    state: dict[tuple[int, int], list[int]] = {}
    for row in sorted(log.collect(), key=lambda row: row.event_id):
        key = (row.users_id, row.plates_id)
        if row.op == "remove":
            state.pop(key, None)
        elif mode == "rows" or key not in state:
            state.setdefault(key, []).append(row.event_id)
    expected = sorted(event for events in state.values() for event in events)
    got = W.fold_reactions(log, mode=mode, hot_rows=hot_rows).collect()
    assert sorted(row.event_id for row in got) == expected


@pytest.mark.parametrize("cap", [30, 10, 3])
def test_pins_one_by_one(views, cap):
    plates = views["plates"]
    pinned = {row.plates_id: bool(row.is_pin) for row in plates.collect()}
    for row in views["unpin_requests"].collect():
        if row.plates_id in pinned:
            pinned[row.plates_id] = False
    for row in sorted(views["pin_requests"].collect(), key=lambda row: row.request_id):
        if sum(pinned.values()) < cap and row.plates_id in pinned:
            pinned[row.plates_id] = True
    after = W.capped_pins(plates, views["pin_requests"], views["unpin_requests"], cap).collect()
    assert {row.plates_id: bool(row.is_pin) for row in after} == pinned


def test_edits_one_by_one(views):
    fields = ("information", "is_selling", "total")
    state = {row.plates_id: row.asDict() for row in views["plates"].collect()}
    for row in sorted(views["plate_edits"].collect(), key=lambda row: row.request_id):
        for field in fields:
            if row.plates_id in state and row[f"edits_{field}"]:
                state[row.plates_id][field] = row[field]
    got = W.apply_field_edits(views["plates"], "plates_id", views["plate_edits"], fields).collect()
    assert {row.plates_id: row.asDict() for row in got} == state
    assert any(row["information"] is None for row in state.values())


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_media_one_by_one(views, hot_rows):
    owner = {"profile_uri": ("users", "users_id"), "cover_uri": ("users", "users_id"), "plates_uri": ("plates", "plates_id")}
    state = {
        name: by_key([row.asDict() for row in views[name].collect()], key)
        for name, key in (("users", "users_id"), ("plates", "plates_id"))
    }
    replaced = []
    for row in sorted(views["media_requests"].collect(), key=lambda row: row.request_id):
        for field, prefix in (
            ("profile_uri", "profile/profile_"), ("cover_uri", "cover/cover_"), ("plates_uri", "plates/plates_"),
        ):
            if prefix in row.object_key:
                target = state[owner[field][0]].get(row.id)
                if target is not None:
                    if target[field] is not None:
                        replaced.append((field, row.id, target[field]))
                    target[field] = None if row.object_key == prefix else row.object_key
                break
    users, plates, requests = views["users"], views["plates"], views["media_requests"]
    got = {row.users_id: row.asDict() for row in W.apply_media_updates(users, "users_id", requests).collect()}
    assert got == state["users"]
    got = {row.plates_id: row.asDict() for row in W.apply_media_updates(plates, "plates_id", requests).collect()}
    assert got == state["plates"]
    keys = W.replaced_media(users, plates, requests, hot_rows=hot_rows).collect()
    assert sorted(tuple(row) for row in keys) == sorted(replaced)


def test_verifications_one_by_one(views):
    issued = {row.verification_id: row.asDict() for row in views["verification"].collect()}
    expected = []
    for row in sorted(views["verification_attempt"].collect(), key=lambda row: (row.attempt_ts, row.attempt_id)):
        known = issued.get(row.verification_id)
        fits = known and known["reference"] == row.reference and known["code"] == row.code
        if fits and not known["verified"] and known["expire"] > row.attempt_ts:
            known["verified"] = True
            expected.append(row.attempt_id)
    got = W.match_verifications(views["verification_attempt"], views["verification"]).collect()
    assert sorted(row.attempt_id for row in got) == sorted(expected)


def test_transfers_one_by_one(views):
    transfers = {row.transfer_plates_id: row.asDict() for row in views["transfer_plates"].collect()}
    for row in sorted(views["accept_requests"].collect(), key=lambda row: row.request_id):
        if row.transfer_plates_id in transfers:
            transfers[row.transfer_plates_id].update(received=True, received_date=row.received_date)
    accepted = W.accept_transfers(views["transfer_plates"], views["accept_requests"])
    assert {row.transfer_plates_id: row.asDict() for row in accepted.collect()} == transfers
    owners = {row.plates_id: row.users_id for row in views["plates"].collect()}
    for row in sorted(
        (t for t in transfers.values() if t["received"]),
        key=lambda t: (t["received_date"], t["transfer_plates_id"]),
    ):
        if row["plates_id"] in owners:
            owners[row["plates_id"]] = row["store_id"]
    moved = W.apply_transfers(views["plates"], accepted).collect()
    assert {row.plates_id: row.users_id for row in moved} == owners


def test_signups_one_by_one(views):
    emails = {row.email for row in views["users"].collect()}
    next_id = max(row.users_id for row in views["users"].collect()) + 1
    expected = {}
    for row in sorted(views["signup_batch"].collect(), key=lambda row: row.request_id):
        email = row.email.strip().lower()
        if "@" not in email:
            expected[row.request_id] = ("invalid", None, None)
        elif email in emails:
            expected[row.request_id] = ("conflict", None, None)
        else:
            emails.add(email)
            expected[row.request_id] = ("admitted", next_id, email.split("@")[0])
            next_id += 1
    got = W.admit_signups(views["signup_batch"], views["users"]).collect()
    assert {row.request_id: (row.status, row.users_id, row.name) for row in got} == expected
    assert {status for status, *_ in expected.values()} == {"admitted", "conflict", "invalid"}


def test_numbers_over_many_ranges(spark):
    keys = [-5, -1, 0, 7, 262_143, 262_144, 1_000_000, 2_147_483_647, -2_147_483_648]
    got = number_rows(spark.createDataFrame([(key,) for key in keys], "k int"), "k").collect()
    assert {row.k: row.ordinal for row in got} == {key: place + 1 for place, key in enumerate(sorted(keys))}


def test_numbers_of_wide_keys(spark):
    """64-bit keys: far apart, close together and of both signs; ranks in many ranges, blocks and top ranges."""
    keys = {-(1 << 63), (1 << 63) - 1, 0, -1}
    for shift in (0, 17, 18, 33, 34, 49, 50, 62):
        keys |= {sign * ((1 << shift) + step) for step in range(-3, 4) for sign in (-1, 1)}
    keys |= {(plate << 32) + tag for plate in range(0, 3000, 7) for tag in (1, 2, 500_000)}
    df = spark.createDataFrame([(key,) for key in sorted(keys, key=hash)], "k long").repartition(5)
    numbered = number_rows(df, "k")
    assert {row.k: row.ordinal for row in numbered.collect()} == {key: place + 1 for place, key in enumerate(sorted(keys))}


def test_wide_numbering_has_no_growing_window_or_broadcast(spark):
    """The only window in one task is over the top ranges, and nothing is broadcast by a hint."""
    numbered = number_rows(spark.range(10).select(F.col("id").alias("k")), "k")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    single = [line for line in plan.splitlines() if "Window" in line and "RowFrame" in line and "row_number" not in line]
    assert len([line for line in single if "_block" not in line.split("AS")[0] and "windowspecdefinition(_range" in line]) == 1
    assert "broadcast" not in plan.lower()


def test_pairs_are_numbered_in_order(spark):
    batch = spark.createDataFrame([(p, h, p * 10 + h) for p in range(1, 200) for h in (3, 1, 2)], "plates_id int, hashtag_id int, seq int")
    batch = batch.selectExpr("*", "TIMESTAMP_NTZ '2024-06-01' AS add_date")
    table = spark.createDataFrame([(40, 5, 2)], "plates_hashtag_id int, plates_id int, hashtag_id int")
    got = W.admitted_plate_hashtags(batch, table).collect()
    pairs = sorted((p, h) for p in range(1, 200) for h in (1, 2, 3) if (p, h) != (5, 2))
    assert {(r.plates_id, r.hashtag_id): r.plates_hashtag_id for r in got} == {pair: 41 + k for k, pair in enumerate(pairs)}


def test_email_shapes(spark):
    good = [
        "a@b", "simple@example.com", "very.common@example.com", "a+b=c@sub.example.co", '"john..doe"@example.org',
        "x@[123.123.123.123]", "ก@ข.com", "a" * 64 + "@example.com",
    ]
    bad = [
        "", "abc.example.com", "a@b@c", "a..b@c.com", ".a@c.com", "a.@c.com", "a b@c.com", "a@-b.com",
        "a@b-.com", "a@b..com", "a@", "@b", "a" * 65 + "@example.com", "a@" + "b" * 64 + ".com", None,
    ]
    df = spark.createDataFrame([(value,) for value in good + bad], "email string")
    got = [row.ok for row in df.select(email_shape_ok("email").alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_clean_email(spark):
    df = spark.createDataFrame([("  A@B.Com\t\n",)], "email string")
    assert df.select(clean_email("email").alias("e")).first().e == "a@b.com"
