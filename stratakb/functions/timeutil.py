"""ISO time stamps kept as strings, their ages and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(c: Column) -> Column:
    """Seconds since the epoch of YYYY-MM-DDTHH:MM:SS..., by the civil calendar; null if it isn't of that shape.

    Fields out of range carry over and whatever follows the seconds is ignored.
    """
    part = lambda i, n: F.substring(c, i, n).try_cast("bigint")
    ok = (F.octet_length(c) >= 20) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-") & (F.substring(c, 11, 1) == "T")
    y0, m, d = part(1, 4), part(6, 2), part(9, 2)
    y = F.when(m <= 2, y0 - 1).otherwise(y0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    days = era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468
    return F.when(ok, (days * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)).cast("bigint"))


def iso(seconds: Column) -> Column:
    """The stamp of seconds since the epoch (the session's zone is UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_days(created: Column, now: Column) -> Column:
    """Not below 0; null if a stamp can't be read."""
    days = (iso_seconds(now) - iso_seconds(created)) / 86400.0
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))


def decayed(confidence: Column, created: Column, now: Column, half_life: float = 180.0, floor: float = 0.2) -> Column:
    """Halves every half_life days, not below the floor (which lifts lower ones); an unreadable stamp has no age."""
    return F.greatest(F.lit(floor), confidence * F.pow(F.lit(0.5), F.coalesce(age_days(created, now), F.lit(0.0)) / half_life))


def recency(created: Column, now: Column, days: float = 365.0) -> Column:
    """1 now to 0 after so many days; 0.5 if the stamp can't be read."""
    age = age_days(created, now)
    return F.when(age.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / days)))


def bumped(now: Column, current: Column) -> Column:
    """A stamp strictly newer than the current one."""
    return iso(F.greatest(iso_seconds(now), F.coalesce(iso_seconds(current) + 1, iso_seconds(now))))
