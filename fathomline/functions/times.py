"""Times as epoch seconds: literals, columns and calendar buckets."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ast import GRANULARITIES
from ..errors import CommandError

#: Most digits of an integer time in each unit, and units in a second.
UNITS = ((11, 1), (14, 1_000), (16, 1_000_000), (19, 1_000_000_000))
#: Seconds of a naive bucket.
NAIVE = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")

_RFC3339 = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)")
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")


def seconds_of_integer(n: int) -> int | None:
    """By its number of digits in s, ms, µs or ns; divided towards zero."""
    for digits, unit in UNITS:
        if len(str(abs(n))) <= digits:
            return int(math.copysign(abs(n) // unit, n))
    return None


def parse_time(value: Any) -> int | None:
    """Epoch seconds of a number or text; None if it is no time."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return seconds_of_integer(value)
    if isinstance(value, float):
        return math.floor(value)
    text = str(value).strip()
    try:
        if _RFC3339.fullmatch(text):
            return math.floor(datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.upper().replace("Z", "+00:00"))).timestamp())
        if _DATE.fullmatch(text):
            return int(datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp())
        return seconds_of_integer(int(text))
    except ValueError:
        return None


def normalize(value: Any) -> int:
    got = parse_time(value)
    if got is None:
        raise CommandError(f"not a time: {value!r}")
    return got


def normalized(column: Column) -> Column:
    """The same for a column of integers, doubles (floored) or texts; null where it is no time."""
    text = F.trim(column.cast("string"))
    number = text.try_cast("decimal(38,0)")
    digits = F.length(F.abs(number).cast("string"))
    branches = None
    for most, unit in UNITS:
        value = F.when(number < 0, -F.floor(-number / unit)).otherwise(F.floor(number / unit)).cast("long")
        branches = F.when(digits <= most, value) if branches is None else branches.when(digits <= most, value)
    is_integer = text.rlike(r"^[+-]?\d+$")
    is_float = text.rlike(r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$|^[+-]?\d+(\.\d*)?[eE][+-]?\d+$")
    is_time = text.rlike(r"^\d{4}-\d\d?-\d\d?$") | text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(is_integer, branches).when(is_float, F.floor(text.try_cast("double")).cast("long")).when(is_time, F.unix_seconds(F.try_to_timestamp(text)))


def bucket(seconds: Column, granularity: str, zone: str = "UTC", week_start: str = "mon", naive: bool = False) -> Column:
    """Epoch second at which the bucket of `seconds` begins, in the calendar of the zone; naive: of fixed length."""
    granularity = granularity.lower()
    if granularity not in GRANULARITIES:
        raise CommandError(f"unknown time bucket: {granularity}")
    if naive:
        size = NAIVE[granularity]
        return (seconds - F.pmod(seconds, F.lit(size))).cast("long")
    local = F.timestamp_seconds(seconds)
    if zone != "UTC":
        local = F.from_utc_timestamp(local, zone)
    if granularity == "week":
        day = F.to_date(local)
        back = F.pmod(F.dayofweek(day) - F.lit(WEEKDAYS.index(week_start[:3].lower()) + 1), F.lit(7)).cast("int")
        start = F.date_sub(day, back).cast("timestamp")
    else:
        start = F.date_trunc(granularity, local)
    if zone != "UTC":
        start = F.to_utc_timestamp(start, zone)
    return F.unix_seconds(start)
