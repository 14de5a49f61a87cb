"""Text-valued column helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the key prefixes that route an uploaded object, in order of precedence.
MEDIA_PREFIXES = {
    "profile_uri": "profile/profile_",
    "cover_uri": "cover/cover_",
    "plates_uri": "plates/plates_",
}

# The two identity texts that reject duplicates.
PLATE_IDENTITY_FORMAT = (
    "province_id(%d)-vehicle_type_id(%d)-front_number(%d)-front_text(%s)-back_number(%d)"
)
HASHTAG_IDENTITY_FORMAT = "plates_id(%d)-hashtag_id(%d)"

# Columns behind the plate identity, in the order of the text.
PLATE_IDENTITY = ["province_id", "vehicle_type_id", "front_number", "front_text", "back_number"]


def pg_timestamp_text(column: Column | str) -> Column:
    """UTC timestamp printed with its zone: ``2024-03-10 15:56:52.3408+00``."""
    value = F.col(column) if isinstance(column, str) else column
    return F.concat(value.cast("string"), F.lit("+00"))


def plate_identity() -> Column:
    return F.format_string(PLATE_IDENTITY_FORMAT, *PLATE_IDENTITY)


def hashtag_identity() -> Column:
    return F.format_string(HASHTAG_IDENTITY_FORMAT, "plates_id", "hashtag_id")


def clean_email(column: Column | str) -> Column:
    """Outer white space (any Unicode kind) removed, then lower case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\x{80}-\x{10FFFF}-]+"
_LOCAL = rf'({_ATOM}(\.{_ATOM})*|"([^"\\\p{{Cntrl}}]|\\.)*")'
_EDGE = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
_LABEL = rf"{_EDGE}([A-Za-z0-9\x{{80}}-\x{{10FFFF}}-]{{0,61}}{_EDGE})?"
_DOMAIN = rf"({_LABEL}(\.{_LABEL})*|\[[^\[\]\\]+\])"
_EMAIL = f"^{_LOCAL}@{_DOMAIN}$"
_LOCAL_LENGTH, _DOMAIN_LENGTH, _LABEL_LENGTH = 64, 254, 63


def email_shape_ok(column: Column | str) -> Column:
    """Address syntax by the public mail rules: dotted atoms or a quoted local part, host labels or a literal.

    A shape check only. A host without a dot is allowed, as those rules allow it.
    """
    value = F.col(column) if isinstance(column, str) else column
    local = F.regexp_extract(value, "^(.*)@", 1)
    domain = F.substring_index(value, "@", -1)
    return F.coalesce(
        value.rlike(_EMAIL)
        & (F.octet_length(local) <= _LOCAL_LENGTH)
        & (F.octet_length(domain) <= _DOMAIN_LENGTH)
        & ~F.exists(F.split(domain, r"\."), lambda label: (F.octet_length(label) > _LABEL_LENGTH) & ~label.startswith("[")),
        F.lit(False),
    )


def default_name(column: Column | str) -> Column:
    """Display name of a new account: everything before the first ``@``."""
    return F.substring_index(column, "@", 1)


def media_target(column: Column | str, prefixes: Mapping[str, str] = MEDIA_PREFIXES) -> Column:
    """Column an object key belongs to, or NULL for an unknown key. The first matching prefix wins."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(
        *[F.when(value.contains(prefix), F.lit(name)) for name, prefix in prefixes.items()]
    )


def media_value(column: Column | str, prefixes: Mapping[str, str] = MEDIA_PREFIXES) -> Column:
    """Value to store: the key itself, or NULL where the key is nothing but a prefix."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(~value.isin(list(prefixes.values())), value)
