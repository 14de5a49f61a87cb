"""Batches of changes. Each job takes the tables and a batch of requests and returns the new state
one would reach by handling the requests one after the other in ``request_id`` order.

Ids are unique 32-bit integers in every table and batch. Nothing here depends on the wall clock:
the instant of a batch is a parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    MEDIA_PREFIXES,
    PLATE_IDENTITY,
    clean_email,
    default_name,
    email_shape_ok,
    hashtag_identity,
    media_target,
    media_value,
    plate_identity,
)
from ..operators.classify import classify
from ..operators.latest import latest_by
from ..operators.numbering import highest, number_rows
from ..operators.skew import HOT_ROWS, spread_lookup
from ..sources.tables import publish

PIN_CAP = 30


# -- admission -------------------------------------------------------------------------------


def first_claims(
    batch: DataFrame, existing: DataFrame, identity: Sequence[str], order: str
) -> DataFrame:
    """(identity, order) of the first request of every identity that ``existing`` does not hold.

    The batch is reduced to one row per identity before it meets the table. The semi join sits
    above the distinct so that Catalyst can move it into the table scan when the batch is small
    enough to broadcast, and otherwise joins two already reduced sides.
    """
    keys = list(identity)
    claims = batch.groupBy(*keys).agg(F.min(order).alias(order))
    taken = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(claims, keys, "left_semi")
    return claims.join(taken, keys, "left_anti")


def admit_new_plates(batch: DataFrame, plates: DataFrame) -> DataFrame:
    """Every request with its ``status``: ``admitted`` with a new plates_id, or ``conflict``.

    A request conflicts when its identity is already listed or was requested earlier in the batch.
    New ids follow the highest one in request order.
    """
    return admit_against(batch, plates, highest(plates, "plates_id"))


def admit_against(batch: DataFrame, listed: DataFrame, last_id: Column) -> DataFrame:
    """``admit_new_plates`` where ``listed`` holds at least those identities that the batch asks for, ``last_id`` the highest id."""
    winners = first_claims(batch, listed, PLATE_IDENTITY, "request_id").select("request_id")
    numbered = number_rows(winners, "request_id")
    won = F.col("ordinal").isNotNull()
    return batch.join(numbered, "request_id", "left").select(
        (last_id + F.col("ordinal")).cast("int").alias("plates_id"),
        *batch.columns,
        plate_identity().alias("unique_text"),
        F.when(won, "admitted").otherwise("conflict").alias("status"),
    )


def admitted_plates(decisions: DataFrame, now: Column) -> DataFrame:
    """The admitted requests as plate rows. Flags start out as: for sale, request's own, not pinned."""
    return decisions.where(F.col("status") == "admitted").select(
        "plates_id",
        "front_text",
        "plates_type_id",
        F.lit(None).cast("string").alias("plates_uri"),
        "total",
        now.alias("add_date"),
        "front_number",
        "back_number",
        "vehicle_type_id",
        "users_id",
        "special_front_id",
        "province_id",
        "information",
        F.lit(True).alias("is_selling"),
        "is_temporary",
        F.lit(False).alias("is_pin"),
        "unique_text",
    )


def new_plate_prices(decisions: DataFrame, price_history: DataFrame, now: Column) -> DataFrame:
    """First price row of each admitted plate that is not temporary, ids after the highest one."""
    priced = decisions.where((F.col("status") == "admitted") & ~F.col("is_temporary"))
    numbered = number_rows(priced.select("plates_id", "price"), "plates_id")
    return numbered.select(
        (highest(price_history, "price_history_id") + F.col("ordinal")).cast("int").alias("price_history_id"),
        "plates_id",
        "price",
        now.alias("add_date"),
    )


def new_plate_patterns(decisions: DataFrame, now: Column) -> DataFrame:
    """Pattern memberships of each admitted plate, temporary or not."""
    return classify(admitted_plates(decisions, now))


def admit_plate_hashtags(batch: DataFrame, plates_hashtag: DataFrame) -> DataFrame:
    """First request (by ``seq``, then ``add_date``) of every new plate-hashtag pair.

    Two steps with fixed-width buffers, so both stay hash aggregates: the earliest date of each
    request place, then the first place with its date.
    """
    pair = ["plates_id", "hashtag_id"]
    dated = batch.groupBy(*pair, "seq").agg(F.min("add_date").alias("add_date"))
    claims = dated.groupBy(*pair).agg(F.min("seq").alias("seq"), F.min_by("add_date", "seq").alias("add_date"))
    taken = plates_hashtag.groupBy(*pair).agg(F.count(F.lit(1)).alias("_rows")).join(claims, pair, "left_semi")
    return claims.join(taken, pair, "left_anti").select(
        *pair, "seq", "add_date", hashtag_identity().alias("unique_text")
    )


def admitted_plate_hashtags(batch: DataFrame, plates_hashtag: DataFrame) -> DataFrame:
    """The admitted pairs as rows of the table, ids after the highest one in (plate, hashtag) order."""
    admitted = admit_plate_hashtags(batch, plates_hashtag)
    key = F.col("plates_id").cast("long") * F.lit(1 << 32) + F.col("hashtag_id")
    return number_rows(admitted.withColumn("_pair", key), "_pair").select(
        (highest(plates_hashtag, "plates_hashtag_id") + F.col("ordinal")).cast("int").alias("plates_hashtag_id"),
        "plates_id",
        "hashtag_id",
        "add_date",
        "unique_text",
    )


def admitted_users(decisions: DataFrame, now: Column) -> DataFrame:
    """The admitted signups as user rows: the instant counts as creation and as first sign-in."""
    empty = F.lit(None).cast("string")
    return decisions.where(F.col("status") == "admitted").select(
        "users_id",
        "name",
        "email",
        now.alias("created_date"),
        now.alias("latest_sign_in"),
        empty.alias("profile_uri"),
        empty.alias("cover_uri"),
        empty.alias("information"),
    )


def admit_signups(batch: DataFrame, users: DataFrame) -> DataFrame:
    """Every signup with its cleaned email and ``status``: ``admitted``, ``invalid`` or ``conflict``.

    Admitted ones get a new users_id in request order and a name made from the email.
    """
    cleaned = batch.withColumn("email", clean_email("email")).withColumn(
        "_valid", email_shape_ok("email")
    )
    winners = first_claims(cleaned.where("_valid"), users, ["email"], "request_id")
    numbered = number_rows(winners.select("request_id"), "request_id")
    won = F.col("ordinal").isNotNull()
    return cleaned.join(numbered, "request_id", "left").select(
        "request_id",
        "email",
        F.when(~F.col("_valid"), "invalid").when(won, "admitted").otherwise("conflict").alias("status"),
        (highest(users, "users_id") + F.col("ordinal")).cast("int").alias("users_id"),
        F.when(won, default_name("email")).alias("name"),
    )


def match_verifications(attempts: DataFrame, issued: DataFrame) -> DataFrame:
    """Attempts that verify: id, reference and code fit an unverified row that has not expired.

    A row verifies once, by its earliest fitting attempt. Only the earliest attempt per (id,
    reference, code) can be that one, so repeated attempts are reduced before the join.
    """
    keys = ["verification_id", "reference", "code"]
    earliest = attempts.groupBy(*keys).agg(
        F.min(F.struct("attempt_ts", "attempt_id")).alias("_attempt")
    )
    open_rows = issued.where(F.col("verified").eqNullSafe(F.lit(False))).select(*keys, "expire")
    return (
        earliest.join(open_rows, keys)
        .where(F.col("expire") > F.col("_attempt.attempt_ts"))
        .select("_attempt.attempt_id", *keys, "_attempt.attempt_ts", "expire")
    )


# -- appends -----------------------------------------------------------------------------------


def append_prices(price_history: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Price history with the batch's prices added; their ids grow, so they become the current ones."""
    added = number_rows(batch, "request_id").select(
        (highest(price_history, "price_history_id") + F.col("ordinal")).cast("int").alias("price_history_id"),
        "plates_id",
        "price",
        now.alias("add_date"),
    )
    return price_history.unionByName(added)


def append_hashtags(hashtag: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Tags with the batch's tags added; equal tags are allowed."""
    added = number_rows(batch, "request_id").select(
        (highest(hashtag, "hashtag_id") + F.col("ordinal")).cast("int").alias("hashtag_id"),
        "tag",
        now.alias("add_date"),
    )
    return hashtag.unionByName(added)


def request_transfers(transfers: DataFrame, batch: DataFrame) -> DataFrame:
    """Transfers with the batch's requests added, not yet received."""
    added = number_rows(batch, "request_id").select(
        (highest(transfers, "transfer_plates_id") + F.col("ordinal")).cast("int").alias("transfer_plates_id"),
        "plates_id",
        "users_id",
        "store_id",
        "add_date",
        F.lit(False).alias("received"),
        F.lit(None).cast(transfers.schema["received_date"].dataType).alias("received_date"),
    )
    return transfers.unionByName(added)


# -- edits -------------------------------------------------------------------------------------


def apply_field_edits(
    table: DataFrame, key: str, edits: DataFrame, fields: Sequence[str], order: str = "request_id"
) -> DataFrame:
    """Table after the edits: the last edit of each key and field wins, unknown keys change nothing.

    An edit may set NULL. A batch that edits only some fields per request says which in boolean
    columns ``edits_<field>``; without such a column every request edits the field.
    """
    last = []
    for field in fields:
        flag = f"edits_{field}"
        made = F.when(F.col(flag), F.col(order)) if flag in edits.columns else F.col(order)
        last.append(F.max_by(field, made).alias(f"_new_{field}"))
        last.append(F.max(made).isNotNull().alias(f"_has_{field}"))
    per_key = edits.groupBy(key).agg(*last)
    columns = [
        F.when(F.col(f"_has_{name}"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
        if name in fields
        else F.col(name)
        for name in table.columns
    ]
    return table.join(per_key, key, "left").select(*columns)


def pinned_count(plates: DataFrame) -> DataFrame:
    return plates.agg(F.count_if(F.col("is_pin")).alias("pinned"))


def capped_pins(
    plates: DataFrame, pins: DataFrame, unpins: DataFrame, cap: int = PIN_CAP
) -> DataFrame:
    """Plates after a batch of pin changes: unpins first, then pins while fewer than ``cap`` are pinned.

    The cap counts all plates of all sellers. Requests for unknown or already pinned plates use no
    slot. Only the first ``cap`` candidates can win, so the ranking never sees more than that.
    """
    is_pinned = F.col("is_pin").eqNullSafe(F.lit(True))
    flags = plates.select("plates_id", "is_pin")
    released = unpins.select("plates_id", F.lit(False).alias("_state")).distinct()
    still_pinned = flags.where(is_pinned).join(released, "plates_id", "left_anti")
    slots = F.lit(cap) - still_pinned.agg(F.count(F.lit(1))).scalar()
    first_requests = pins.groupBy("plates_id").agg(F.min("request_id").alias("request_id"))
    candidates = (
        first_requests.join(flags, "plates_id")
        .join(released, "plates_id", "left")
        .where(~is_pinned | F.col("_state").isNotNull())
        .select("plates_id", "request_id")
        .orderBy("request_id")
        .limit(cap)
    )
    place = F.row_number().over(Window.orderBy("request_id"))
    winners = (
        candidates.withColumn("_place", place)
        .where(F.col("_place") <= slots)
        .select("plates_id", F.lit(True).alias("_won"))
    )
    # At most ``cap`` winners, and a plate released and pinned again ends up pinned.
    return (
        plates.join(released, "plates_id", "left")
        .join(winners, "plates_id", "left")
        .withColumn("is_pin", F.coalesce("_won", "_state", "is_pin"))
        .select(*plates.columns)
    )


def delete_rows(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Table without the listed keys. Rows of other tables that point to them stay and drop out of the joins."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def accept_transfers(transfers: DataFrame, accepts: DataFrame) -> DataFrame:
    """Transfers with the accepted ones marked; of several requests the last one sets the date."""
    last = accepts.groupBy("transfer_plates_id").agg(F.max_by("received_date", "request_id").alias("_accepted"))
    accepted = F.col("_accepted").isNotNull()
    return (
        transfers.join(last, "transfer_plates_id", "left")
        .withColumn("received", F.when(accepted, F.lit(True)).otherwise(F.col("received")))
        .withColumn("received_date", F.when(accepted, F.col("_accepted")).otherwise(F.col("received_date")))
        .drop("_accepted")
        .select(*transfers.columns)
    )


def apply_transfers(plates: DataFrame, transfers: DataFrame) -> DataFrame:
    """Plates with their new owner: the store of the latest received transfer of each plate."""
    owner = (
        transfers.where("received")
        .groupBy("plates_id")
        .agg(F.max_by("store_id", F.struct("received_date", "transfer_plates_id")).alias("_owner"))
    )
    return (
        plates.join(owner, "plates_id", "left")
        .withColumn("users_id", F.coalesce("_owner", "users_id"))
        .drop("_owner")
        .select(*plates.columns)
    )


# -- reactions ---------------------------------------------------------------------------------


def fold_reactions(
    log: DataFrame,
    target: str = "plates_id",
    order: str = "event_id",
    mode: str = "rows",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Reaction rows left after a log of adds and removes.

    An add always adds a row; a remove deletes every row of its user and target, so the adds after
    the last remove survive. ``mode="set"`` keeps the first surviving row per user and target. The
    same function serves plates and stores, likes and saves.
    """
    key = ["users_id", target]
    is_add = F.col("op") == "add"
    per_key = log.groupBy(*key).agg(
        F.max(F.when(F.col("op") == "remove", F.col(order))).alias("_last_remove"),
        F.count_if(is_add).alias("_rows"),
    )
    adds = log.where(is_add).drop("op")
    lookup = per_key.select(*key, "_last_remove")
    sizes = per_key.select(*key, "_rows")
    survivors = (
        spread_lookup(adds, lookup, key, order, sizes, "inner", hot_rows)
        .where(F.col("_last_remove").isNull() | (F.col(order) > F.col("_last_remove")))
        .select(*adds.columns)
    )
    if mode == "rows":
        return survivors
    if mode != "set":
        raise ValueError(f"mode must be 'rows' or 'set', not {mode!r}")
    rest = [name for name in survivors.columns if name not in (*key, order)]
    first = survivors.groupBy(*key).agg(
        F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("_row")
    )
    return first.select(*key, order, "_row.*").select(*adds.columns)


# -- media -------------------------------------------------------------------------------------


def route_media(
    requests: DataFrame, prefixes: Mapping[str, str] = MEDIA_PREFIXES
) -> DataFrame:
    """Requests with the ``field`` they address (NULL: rejected) and the ``value`` they store."""
    return requests.select(
        "request_id",
        "id",
        "object_key",
        media_target("object_key", prefixes).alias("field"),
        media_value("object_key", prefixes).alias("value"),
    )


def _media_state(
    users: DataFrame, plates: DataFrame, fields: Sequence[str]
) -> DataFrame:
    """(field, id, value) of every media column, unpivoted."""
    owners = {"users_id": users, "plates_id": plates}
    parts = []
    for field in fields:
        key = next(name for name, table in owners.items() if field in table.columns)
        parts.append(
            owners[key].select(
                F.lit(field).alias("field"), F.col(key).alias("id"), F.col(field).alias("value")
            )
        )
    state = parts[0]
    for part in parts[1:]:
        state = state.unionByName(part)
    return state


def apply_media_updates(
    table: DataFrame,
    key: str,
    requests: DataFrame,
    prefixes: Mapping[str, str] = MEDIA_PREFIXES,
) -> DataFrame:
    """Users or plates after the media requests: the last request of each row and column wins.

    A bare prefix clears the column; a key with no known prefix is ignored.
    """
    routed = route_media(requests, prefixes).withColumnRenamed("id", key)
    fields = [name for name in prefixes if name in table.columns]
    edits = routed.select(
        key,
        "request_id",
        *[F.col("value").alias(name) for name in fields],
        *[(F.col("field") == name).alias(f"edits_{name}") for name in fields],
    ).where(F.col(f"edits_{fields[0]}") if len(fields) == 1 else F.expr(" OR ".join(f"edits_{n}" for n in fields)))
    return apply_field_edits(table, key, edits, fields)


def replaced_media(
    users: DataFrame,
    plates: DataFrame,
    requests: DataFrame,
    prefixes: Mapping[str, str] = MEDIA_PREFIXES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Object keys the requests have replaced, for clean-up: (field, id, object_key).

    Those are the stored value of every addressed row and every requested key but the last one of
    its row. Requests for rows that do not exist replace nothing.
    """
    routed = route_media(requests, prefixes).where(F.col("field").isNotNull())
    per_row = routed.groupBy("field", "id").agg(
        F.max("request_id").alias("_last"), F.count(F.lit(1)).alias("_rows")
    )
    touched = per_row.join(_media_state(users, plates, list(prefixes)), ["field", "id"])
    stored = touched.where(F.col("value").isNotNull()).select(
        "field", "id", F.col("value").alias("object_key")
    )
    overwritten = spread_lookup(
        routed.where(F.col("value").isNotNull()),
        touched.select("field", "id", "_last"),
        ["field", "id"],
        "request_id",
        per_row.select("field", "id", "_rows"),
        "inner",
        hot_rows,
    ).where(F.col("request_id") < F.col("_last"))
    return stored.unionByName(overwritten.select("field", "id", "object_key"))


# -- classification ----------------------------------------------------------------------------


def rebuild_patterns(plates: DataFrame, root: str, now: Column | None = None) -> int:
    """Classify the whole catalogue into the next version of a published table partitioned by pattern.

    Readers keep the version before until the new one is complete. The memberships are rebalanced by
    pattern, so AQE cuts a pattern that holds a large share of them into several files and packs rare
    ones together.
    """
    return publish(classify(plates, now).hint("rebalance", "pattern"), root, "pattern")
