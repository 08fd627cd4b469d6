"""Alignment periods: fixed durations and calendar units, in a time zone.

Buckets floor, before the anchor too. Calendar steps are steps of local time, so a day is a day on
both sides of a change of clocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import QueryError

EPOCH = datetime(1970, 1, 1)
DAY_US = 86_400_000_000


def check_zone(name: str | None) -> str:
    try:
        ZoneInfo(name or "UTC")
    except (ZoneInfoNotFoundError, ValueError, OSError) as e:
        raise QueryError(f"unknown time zone {name!r}") from e
    return name or "UTC"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def local(ts: Column, zone: str) -> Column:
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def instant(local_ts: Column, zone: str) -> Column:
    return local_ts if zone == "UTC" else F.to_utc_timestamp(local_ts, zone)


@dataclass(frozen=True)
class FixedPeriod:
    """Buckets of ``us`` microseconds, anchored at the zone's local 1970-01-01 00:00 plus ``offset``."""

    us: int
    offset: int = 0
    zone: str = "UTC"

    def __post_init__(self):
        if self.us <= 0:
            raise QueryError("a period's duration must be positive")
        if self.offset < 0:
            raise QueryError("a period's offset must not be negative")
        check_zone(self.zone)

    @property
    def anchor(self) -> int:
        at = EPOCH.replace(tzinfo=ZoneInfo(self.zone)).utcoffset() or timedelta(0)
        return self.offset % self.us - at // timedelta(microseconds=1)

    @property
    def fixed_us(self) -> int | None:
        return self.us

    @property
    def about_us(self) -> int:
        return self.us

    def bucket(self, ts: Column) -> Column:
        us = micros(ts)
        return F.timestamp_micros(us - F.pmod(us - F.lit(self.anchor), F.lit(self.us)))

    def step(self, bucket: Column, n: Column | int = 1) -> Column:
        return F.timestamp_micros(micros(bucket) + F.lit(self.us) * n)

    def index(self, bucket: Column) -> Column:
        """A bucket's number; consecutive buckets have consecutive numbers."""
        return F.call_function("div", micros(bucket) - F.lit(self.anchor) - F.pmod(micros(bucket) - F.lit(self.anchor), F.lit(self.us)), F.lit(self.us))

    def start(self, index: Column) -> Column:
        return F.timestamp_micros(index * F.lit(self.us) + F.lit(self.anchor))


# Months or days in each calendar unit.
CALENDAR = {"day": ("days", 1), "week": ("days", 7), "month": ("months", 1), "quarter": ("months", 3), "halfYear": ("months", 6), "year": ("months", 12)}


@dataclass(frozen=True)
class CalendarPeriod:
    """Local days, weeks from Monday, months, quarters, half-years or years."""

    unit: str
    zone: str = "UTC"

    def __post_init__(self):
        if self.unit not in CALENDAR:
            raise QueryError(f"unknown calendar period {self.unit!r}")
        check_zone(self.zone)

    @property
    def fixed_us(self) -> int | None:
        return None

    @property
    def about_us(self) -> int:
        kind, n = CALENDAR[self.unit]
        return DAY_US * n * (30 if kind == "months" else 1)

    def bucket(self, ts: Column) -> Column:
        return self.start(self.index(ts))

    def step(self, bucket: Column, n: Column | int = 1) -> Column:
        return self.start(self.index(bucket) + n)

    def index(self, ts: Column) -> Column:
        kind, n = CALENDAR[self.unit]
        day = F.to_date(local(ts, self.zone))
        if kind == "months":
            months = F.year(day) * 12 + F.month(day) - 1
            return F.floor(months / n).cast("long")
        days = F.unix_date(day) + (3 if n == 7 else 0)  # 1970-01-01 was a Thursday
        return F.floor(days / n).cast("long")

    def start(self, index: Column) -> Column:
        kind, n = CALENDAR[self.unit]
        if kind == "months":
            months = index * n
            year = F.floor(months / 12).cast("int")
            day = F.make_date(year, (months - year * 12 + 1).cast("int"), F.lit(1))
        else:
            day = F.date_from_unix_date((index * n - (3 if n == 7 else 0)).cast("int"))
        return instant(day.cast("timestamp"), self.zone)


Period = FixedPeriod | CalendarPeriod


def calendar_period(name: str, zone: str | None = None) -> Period:
    """A period by its name in queries."""
    if name == "hour":
        return FixedPeriod(3_600_000_000, 0, zone or "UTC")
    if name == "quarterHour":
        return FixedPeriod(900_000_000, 0, zone or "UTC")
    return CalendarPeriod(name, check_zone(zone))
