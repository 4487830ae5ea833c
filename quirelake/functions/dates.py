"""Age and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit, largest first.
AGE_UNITS = (("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1))
OLD_AFTER_SECONDS = 30 * 86400


def time_ago(ts: Column, now: Column) -> Column:
    """Age of a Unix second as text. ``now`` is an argument, so runs repeat.

    A NULL (unknown) or future time is ``unknown``; from 30 days on the date is
    shown.
    """
    age = now - ts
    text = F.lit("just now")
    for name, size in reversed(AGE_UNITS):
        count = F.floor(age / size)
        phrase = F.concat(count.cast("string"), F.when(count == 1, F.lit(f" {name} ago")).otherwise(F.lit(f" {name}s ago")))
        text = F.when(age >= size, phrase).otherwise(text)
    return (
        F.when(ts.isNull() | (ts > now), F.lit("unknown"))
        .when(age >= OLD_AFTER_SECONDS, F.date_format(F.timestamp_seconds(ts), "MMM dd, yyyy"))
        .otherwise(text)
    )


def parse_doc_date(text: Column) -> Column:
    """``D:yyyyMMddHHmmss`` with an optional offset, or an ISO date; else NULL."""
    compact = r"^D:(\d{14})(?:([+-]\d{2})'?(\d{2})'?|Z.*)?$"
    digits = F.regexp_extract(text, compact, 1)
    hours = F.regexp_extract(text, compact, 2)
    offset = F.when(hours != "", F.concat(hours, F.lit(":"), F.regexp_extract(text, compact, 3))).otherwise(F.lit("+00:00"))
    return F.when(
        digits != "", F.try_to_timestamp(F.concat(digits, offset), F.lit("yyyyMMddHHmmssxxx"))
    ).otherwise(F.try_to_timestamp(text))
