"""Calendar schedules: weekly slots, yearly periods and dates, as one expression over local time.

A time matches if it lies in [start, end), any condition matches and no exclusion does. In a condition
the kinds of field are all to match, each by any of its items, and then no exclusion of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..meta import QueryError
from ..functions.periods import check_zone, instant, local

# The longest each month can be.
MONTH_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


@dataclass(frozen=True)
class TimeSlot:
    """Minutes of a day, [from, to); it may cross midnight."""

    from_hour: int
    from_minute: int
    to_hour: int
    to_minute: int

    def __post_init__(self):
        if not (0 <= self.from_hour < 24 and 0 <= self.to_hour < 24 and 0 <= self.from_minute < 60 and 0 <= self.to_minute < 60):
            raise QueryError("a time slot's hours are 0 to 23 and its minutes 0 to 59")
        if self.start == self.end:
            raise QueryError("a time slot must not be empty")

    @property
    def start(self) -> int:
        return self.from_hour * 60 + self.from_minute

    @property
    def end(self) -> int:
        return self.to_hour * 60 + self.to_minute

    def matches(self, minute: Column) -> Column:
        inside = (minute >= self.start, minute < self.end)
        return inside[0] & inside[1] if self.start < self.end else inside[0] | inside[1]


@dataclass(frozen=True)
class YearPeriod:
    """Days of a year, both ends included; it may cross the new year."""

    start_month: int
    start_day: int
    end_month: int
    end_day: int

    def __post_init__(self):
        for month, day in ((self.start_month, self.start_day), (self.end_month, self.end_day)):
            if not 1 <= month <= 12 or not 1 <= day <= MONTH_DAYS[month - 1]:
                raise QueryError(f"no day {month}-{day} in a year")

    def matches(self, month_day: Column) -> Column:
        start, end = self.start_month * 100 + self.start_day, self.end_month * 100 + self.end_day
        inside = (month_day >= start, month_day <= end)
        return inside[0] & inside[1] if start <= end else inside[0] | inside[1]


def _dates(given: tuple[str, ...]) -> list[date]:
    try:
        return [date.fromisoformat(d) for d in given]
    except ValueError as e:
        raise QueryError(f"no date: {e}") from e


def _any(found: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, found)


@dataclass(frozen=True)
class ScheduleCondition:
    slots: tuple[TimeSlot, ...] = ()
    weekdays: tuple[int, ...] = ()  # 0 is Sunday
    periods: tuple[YearPeriod, ...] = ()
    dates: tuple[str, ...] = ()
    exclude_periods: tuple[YearPeriod, ...] = ()
    exclude_dates: tuple[str, ...] = ()

    def __post_init__(self):
        if any(not 0 <= d <= 6 for d in self.weekdays):
            raise QueryError("weekdays are 0 (Sunday) to 6")
        _dates(self.dates)
        _dates(self.exclude_dates)

    def matches(self, at: Column) -> Column:
        """``at``: local time."""
        minute, month_day, day = F.hour(at) * 60 + F.minute(at), F.month(at) * 100 + F.dayofmonth(at), F.to_date(at)
        found = [F.lit(True)]
        if self.slots:
            found.append(_any([s.matches(minute) for s in self.slots]))
        if self.weekdays:
            found.append((F.dayofweek(at) - 1).isin(*self.weekdays))
        if self.periods:
            found.append(_any([p.matches(month_day) for p in self.periods]))
        if self.dates:
            found.append(day.isin(*_dates(self.dates)))
        if self.exclude_periods:
            found.append(~_any([p.matches(month_day) for p in self.exclude_periods]))
        if self.exclude_dates:
            found.append(~day.isin(*_dates(self.exclude_dates)))
        return reduce(lambda a, b: a & b, found)


@dataclass(frozen=True)
class Schedule:
    conditions: tuple[ScheduleCondition, ...] = ()
    excludes: tuple[ScheduleCondition, ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    zone: str | None = None

    def __post_init__(self):
        check_zone(self.zone)
        if self.start and self.end and self.start >= self.end:
            raise QueryError("a schedule must start before it ends")

    def matches(self, ts: Column) -> Column:
        at = local(ts, check_zone(self.zone))
        if not self.conditions:
            return F.lit(False)
        found = _any([c.matches(at) for c in self.conditions])
        if self.excludes:
            found = found & ~_any([c.matches(at) for c in self.excludes])
        if self.start:
            found = found & (ts >= F.lit(self.start))
        if self.end:
            found = found & (ts < F.lit(self.end))
        return found

    def matches_day(self, ts: Column) -> Column:
        """Whether any minute of the local day of ``ts`` can match, time slots aside."""
        whole = lambda cs: tuple(ScheduleCondition((), c.weekdays, c.periods, c.dates, c.exclude_periods, c.exclude_dates) for c in cs)
        full = tuple(c for c in self.excludes if not c.slots)
        return Schedule(whole(self.conditions), full, None, None, self.zone).matches(ts)

    def active_windows(self, spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
        """(start, end) of the runs of matching minutes in [start, end); minutes are made for days that can match only."""
        zone = check_zone(self.zone)
        span = spark.range(1).select(F.lit(start).alias("a"), F.lit(end).alias("b"))
        days = span.select(F.explode(F.sequence(F.to_date(local(F.col("a"), zone)), F.to_date(local(F.col("b"), zone)))).alias("day"), "a", "b")
        first, last = instant(F.col("day").cast("timestamp"), zone), instant(F.date_add("day", 1).cast("timestamp"), zone)
        days = days.filter(self.matches_day(first))
        minutes = days.select(F.explode(F.sequence(first, last, F.expr("interval 1 minute"))).alias("m"), last.alias("z"), "a", "b")
        minutes = minutes.filter((F.col("m") < F.col("z")) & (F.col("m") >= F.date_trunc("minute", "a")) & (F.col("m") < F.col("b")) & self.matches(F.col("m")))
        # a run begins and ends where the minute beside does not match: two rows a run are put in order, not its minutes
        minute = F.expr("interval 1 minute")
        begins = ~self.matches(F.col("m") - minute) | (F.col("m") - minute < F.date_trunc("minute", "a"))
        ends = ~self.matches(F.col("m") + minute) | (F.col("m") + minute >= F.col("b"))
        edges = minutes.select("m", "a", "b", begins.alias("begins"), ends.alias("ends")).filter("begins OR ends")
        runs = edges.withColumn("run", F.sum(F.col("begins").cast("int")).over(W.orderBy("m")))
        found = runs.groupBy("run").agg(F.greatest(F.min("m"), F.first("a")).alias("start"), F.least(F.max("m") + F.expr("interval 1 minute"), F.first("b")).alias("end"))
        return found.select("start", "end").orderBy("start")

    def matches_period(self, spark: SparkSession, start: datetime, end: datetime) -> bool:
        return not self.active_windows(spark, start, end).isEmpty()

    def next_match(self, spark: SparkSession, start: datetime, end: datetime) -> datetime | None:
        return self.active_windows(spark, start, end).agg(F.min("start")).first()[0]

    def total_seconds(self, spark: SparkSession, start: datetime, end: datetime) -> int:
        spans = self.active_windows(spark, start, end).select((F.unix_micros("end") - F.unix_micros("start")).alias("us"))
        return (spans.agg(F.sum("us")).first()[0] or 0) // 1_000_000
