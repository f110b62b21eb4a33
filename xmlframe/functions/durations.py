"""ISO 8601 durations: seconds, and calendar addition to an epoch time. Python and Column forms."""

from __future__ import annotations

import calendar
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean lengths in seconds.
MINUTE, HOUR, DAY = 60.0, 3600.0, 86400.0
MONTH, YEAR = 30.4 * DAY, 365.256 * DAY

PATTERN = r"^(-)?P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"
_COMPILED = re.compile(PATTERN)
_UNITS = (YEAR, MONTH, DAY, HOUR, MINUTE, 1.0)


def duration2secs(text: str | None) -> float | None:
    if not text:
        return None
    m = _COMPILED.match(text)
    if not m:
        raise ValueError(f"illegal duration format: {text}")
    total = sum(float(x or 0) * u for x, u in zip(m.groups()[1:], _UNITS))
    return -total if m[1] else total


def add_duration(text: str, since: float) -> float:
    """Years and months by the calendar, with days beyond a month's end running on into the next month."""
    m = _COMPILED.match(text)
    if not m:
        raise ValueError(f"illegal duration format: {text}")
    sign = -1 if m[1] else 1
    y, mo, d, h, mi, s = (float(x or 0) * sign for x in m.groups()[1:])
    t = time.gmtime(int(since))
    months = t.tm_year * 12 + t.tm_mon - 1 + int(y) * 12 + int(mo)
    first = calendar.timegm((months // 12, months % 12 + 1, 1, t.tm_hour, t.tm_min, t.tm_sec))
    return first + (t.tm_mday - 1 + d) * DAY + h * HOUR + mi * MINUTE + s + since - int(since)


def _part(text: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(text, PATTERN, group).try_cast("double"), F.lit(0.0))


def duration2secs_col(text: Column) -> Column:
    """Seconds of a duration column; null stays null and a malformed text raises."""
    total = sum((_part(text, i) * u for i, u in zip(range(2, 8), _UNITS)), F.lit(0.0))
    signed = F.when(F.regexp_extract(text, PATTERN, 1) == "-", -total).otherwise(total)
    bad = F.raise_error(F.concat(F.lit("illegal duration format: "), text)).cast("double")
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("double")).when(text.rlike(PATTERN), signed).otherwise(bad)


def add_duration_col(text: Column, since: Column) -> Column:
    """``since`` (timestamp) plus a duration column; days beyond a month's end run on into the next month."""
    sign = F.when(F.regexp_extract(text, PATTERN, 1) == "-", -1).otherwise(1)
    months = (sign * (_part(text, 2) * 12 + _part(text, 3))).cast("int")
    first = F.add_months(F.trunc(since, "month"), months)
    day = F.date_add(first, (F.dayofmonth(since) - 1).cast("int"))
    inside = F.unix_micros(since) - F.unix_micros(F.date_trunc("day", since))
    rest = sum((sign * _part(text, i) * u for i, u in zip(range(4, 8), _UNITS[2:])), F.lit(0.0))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + inside + F.round(rest * 1_000_000).cast("long"))
