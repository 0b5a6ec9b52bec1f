"""Times as milliseconds since 1970 in UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model

_SHAPE = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[\x00-\x7F]([0-9]{2}):([0-9]{2}):([0-9]{2})([\x00-\x7F]*)$"


def iso_ms(text: Column) -> Column:
    """Milliseconds of an ISO time; null unless it is a real date and time. The
    fraction is cut to milliseconds; a missing or odd offset counts as UTC."""
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(text, _SHAPE, k)
    number = lambda c: c.try_cast("bigint")
    day = F.unix_date(F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")).cast("bigint")
    hour, minute, second = number(part(4)), number(part(5)), number(part(6))
    rest = part(7)
    digits = F.regexp_extract(rest, r"^\.([0-9]+)", 1)
    fraction = F.coalesce(number(F.substring(F.rpad(F.substring(digits, 1, 3), 3, "0"), 1, 3)), F.lit(0))
    tail = F.regexp_replace(rest, r"^\.[0-9]*", "")
    offset = r"^([+-])([0-9]{2}):?([0-9]{2})"
    sign = F.when(F.regexp_extract(tail, offset, 1) == "-", -1).otherwise(1)
    shift = F.coalesce(sign * (number(F.regexp_extract(tail, offset, 2)) * 60 + number(F.regexp_extract(tail, offset, 3))), F.lit(0))
    valid = text.rlike(_SHAPE) & (hour < 24) & (minute < 60) & (second < 60)
    return F.when(valid, day * model.DAY_MS + hour * 3_600_000 + minute * 60_000 + second * 1000 + fraction - shift * 60_000)


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a date, null if there is no such date."""
    return F.unix_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date"))


def format_day(ms: Column) -> Column:
    """``YYYY-MM-DD`` in UTC, or ``unknown``."""
    day = F.date_from_unix_date(F.floor(ms / model.DAY_MS).cast("int"))
    return F.coalesce(day.cast("string"), F.lit("unknown"))


def recency_decay(ms: Column, now_ms: int) -> Column:
    """Halves every 30 days; 1 for the future, 0 without a time."""
    age = F.greatest(F.lit(now_ms) - ms, F.lit(0)) / F.lit(float(model.DAY_MS))
    return F.when(ms.isNull(), 0.0).otherwise(F.exp(-F.ln(F.lit(2.0)) * age / model.HALF_LIFE_DAYS))


def boosted(score: Column, ms: Column, now_ms: int) -> Column:
    return score * (1 + model.RECENCY_WEIGHT * recency_decay(ms, now_ms))
