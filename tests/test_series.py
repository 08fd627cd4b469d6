"""Small series with results worked out by hand."""

from datetime import UTC, datetime, timedelta

import pytest

from tidewheel.functions import expressions as E
from tidewheel.functions.periods import CalendarPeriod, FixedPeriod
from tidewheel.meta import FieldMeta, NewField, QueryError, duration_text, duration_us
from tidewheel.operators import series as S
from tidewheel.operators.schedule import Schedule, ScheduleCondition, TimeSlot, YearPeriod

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def series(values, kind=None, data_type="decimal", required=True, **meta) -> S.StaticSeries:
    """``values``: {seconds: value} or pairs."""
    rows = [(at(t), v) for t, v in (values.items() if isinstance(values, dict) else values)]
    return S.StaticSeries(FieldMeta(data_type, required, kind=kind, urn="x", **meta), rows)


def got(spark, source, *filters, start=None, end=None):
    found = S.FilteredSeries(source, filters).run(spark, start, end)
    rows = found.df.orderBy("ts", "seq").selectExpr("unix_micros(ts) AS us", "value").collect()
    base = int(T0.timestamp() * 1e6)
    return [((r["us"] - base) / 1e6, r["value"]) for r in rows]


MINUTE = FixedPeriod(60_000_000)


def test_interpolating_aligner(spark):
    assert got(spark, series({0: 100.0, 90: 150.0, 150: 250.0, 210: 350.0}), S.Aligner(MINUTE)) == [(0, 100), (60, pytest.approx(100 + 50 * 60 / 90)), (120, 200), (180, 300)]


def test_aligner_skips_empty_buckets_and_fills(spark):
    given = series({0: 100.0, 300: 400.0})
    assert got(spark, given, S.Aligner(MINUTE)) == [(0, 100), (300, 400)]
    assert got(spark, given, S.Aligner(MINUTE, "linear")) == [(60 * k, 100 + 60 * k) for k in range(6)]
    assert got(spark, given, S.Aligner(MINUTE, "forwardFill")) == [(60 * k, 100) for k in range(5)] + [(300, 400)]


def test_aligner_integers_truncate(spark):
    assert got(spark, series({0: 1, 90: 2}, data_type="integer"), S.Aligner(MINUTE)) == [(0, 1), (60, 1)]


def test_aligner_sums_deltas_by_default(spark):
    assert got(spark, series({0: 1.0, 30: 2.0, 70: 5.0}, "delta"), S.Aligner(MINUTE)) == [(0, 3), (60, 5)]


def test_aligner_of_text_is_a_step(spark):
    assert got(spark, series({10: "a", 70: "b", 80: "c"}, data_type="string"), S.Aligner(MINUTE)) == [(0, "a"), (60, "b")]


def test_aligner_null_bracket(spark):
    given = {0: 1.0, 50: None, 70: 3.0}
    assert got(spark, series(given, required=False), S.Aligner(MINUTE)) == [(0, 1), (60, None)]


def test_aligner_errors(spark):
    with pytest.raises(QueryError):
        got(spark, series({0: "a"}, data_type="string"), S.Aligner(MINUTE, reduction="sum"))
    with pytest.raises(QueryError):
        got(spark, series({0: "a"}, data_type="string"), S.Aligner(MINUTE, "linear"))
    with pytest.raises(QueryError):
        got(spark, series({0: 1.0}), S.Aligner(MINUTE, "nearest"))
    with pytest.raises(QueryError):
        got(spark, series({0: 1.0}), S.Aligner(MINUTE, reduction="mae"))
    with pytest.raises(QueryError):
        FixedPeriod(0)
    with pytest.raises(QueryError):
        CalendarPeriod("day", "Nowhere/Land")


def test_calendar_days_across_a_change_of_clocks(spark):
    zone = CalendarPeriod("day", "America/New_York")
    hours = [(datetime(2024, 11, 2, 12, tzinfo=UTC) + timedelta(hours=h), 1.0) for h in range(60)]
    source = S.StaticSeries(FieldMeta("decimal", urn="x"), hours)
    rows = S.FilteredSeries(source, (S.Aligner(zone, reduction="count"),)).run(spark).df.orderBy("ts").selectExpr("cast(ts as string) AS t", "value").collect()
    assert [(r["t"], r["value"]) for r in rows] == [("2024-11-02 04:00:00", 16), ("2024-11-03 04:00:00", 25), ("2024-11-04 05:00:00", 19)]


@pytest.mark.parametrize(("unit", "start"), [("week", "2025-01-06"), ("month", "2025-01-01"), ("quarter", "2025-01-01"), ("halfYear", "2025-01-01"), ("year", "2025-01-01")])
def test_calendar_starts(spark, unit, start):
    source = S.StaticSeries(FieldMeta("decimal", urn="x"), [(datetime(2025, 1, 12, 23, tzinfo=UTC), 1.0)])
    row = S.FilteredSeries(source, (S.Aligner(CalendarPeriod(unit), reduction="sum"),)).run(spark).df.selectExpr("cast(ts as string) AS t").first()
    assert row["t"].startswith(start)


def test_fixed_period_offset_and_zone(spark):
    half = FixedPeriod(3_600_000_000, 0, "Asia/Kolkata")  # local hours start at half past
    assert got(spark, series({0: 1.0, 1900: 2.0}), S.Aligner(half, reduction="sum")) == [(-1800, 1), (1800, 2)]
    assert got(spark, series({0: 1.0, 31: 2.0}), S.Aligner(FixedPeriod(60_000_000, 30_000_000), reduction="sum")) == [(-30, 1), (30, 2)]


def test_range_is_half_open_and_at_the_leaf(spark):
    given = series({0: 1.0, 60: 2.0, 120: 4.0, 180: 8.0}, "cumulative")
    assert got(spark, given, S.DeltaFilter(), start=at(60), end=at(180)) == [(120, 2)]
    assert got(spark, given, S.TimeShift(-120), start=at(60), end=at(120)) == [(-60, 2)]


def test_delta_gap(spark):
    given = {0: 1.0, 60: 3.0, 200: 10.0, 260: 11.0}
    assert got(spark, series(given, "cumulative"), S.DeltaFilter(S.Counter(max_gap=100_000_000))) == [(60, 2), (260, 1)]
    assert got(spark, series(given, "cumulative", sample_period=50_000_000), S.DeltaFilter()) == [(60, 2), (260, 1)]
    assert got(spark, series({0: 1.0, 100: 3.0}, "cumulative"), S.DeltaFilter(S.Counter(max_gap=100_000_000))) == [(100, 2)]


def fold(rows, gap, reset, top):
    """The counter's rules, one reading at a time."""
    out, base = [], None
    for t, v in rows:
        if base is None or (gap and t - base[0] > gap):
            base = (t, v)
        elif v >= 0:
            less = {"zero": 0, "emit": v, "wrap": (top - base[1]) + v}[reset]
            out.append((t, v - base[1] if v >= base[1] else less))
            base = (t, v)
    return out


@pytest.mark.parametrize("reset", ["zero", "emit", "wrap"])
@pytest.mark.parametrize("gap", [None, 40])
def test_counter_against_the_fold(spark, reset, gap):
    import random

    random.seed(f"{reset}{gap}")
    times = sorted(random.sample(range(1000), 90))
    rows = [(t, random.choice([-3, -1, 0, 2, 5, 9, 14])) for t in times]
    counter = S.Counter(True, 100 if reset == "wrap" else None, reset == "emit", gap * 1_000_000 if gap else None)
    assert got(spark, series(rows, "cumulative", "integer"), S.DeltaFilter(counter)) == fold(rows, gap, reset, 100)


def test_rate(spark):
    given = series({0: 10, 30: 40, 90: 40}, "cumulative", "integer")
    assert got(spark, given, S.RateFilter("per minute", 60)) == [(30, 60), (90, 0)]
    found = S.RateFilter("kW").apply(given.run(spark)).meta
    assert (found.data_type, found.kind, found.unit, found.sample_period) == ("decimal", "rate", "kW", None)


def test_delta_and_rate_errors(spark):
    for kind in (None, "gauge", "delta", "rate"):
        with pytest.raises(QueryError):
            got(spark, series({0: 1.0}, kind), S.DeltaFilter())
    for wrong in (series({0: "a"}, data_type="string"), series({0: 1.0}, required=False), series({0: 1.0}, "rate")):
        with pytest.raises(QueryError):
            got(spark, wrong, S.RateFilter())
    for counter in ((False, 5.0), (False, None, True), (True, 5.0, True), (False, None, False, 0)):
        with pytest.raises(QueryError):
            S.Counter(*counter)
    with pytest.raises(QueryError):
        S.TimeShift(0)
    with pytest.raises(Exception, match="no time"):
        got(spark, series([(0, 1.0), (0, 2.0)], "cumulative"), S.RateFilter())


def test_align_delta_appends_the_last_row(spark):
    found = S.align_delta(series({0: 0.0, 60: 60.0, 90: 90.0}).run(spark), MINUTE).df.orderBy("ts").select("value").collect()
    assert [r[0] for r in found] == [60, 30]
    found = S.align_delta(series({0: 0.0, 60: 60.0}).run(spark), MINUTE).df.select("value").collect()
    assert [r[0] for r in found] == [60]


def test_reduction_across_series(spark):
    a, b, c = (series(v) for v in ({0: 1.0, 60: 2.0}, {0: 3.0, 60: 6.0, 120: 7.0}, {0: 5.0, 60: 1.0}))
    many = S.ListSeries((a, b, c))
    run = lambda r, **k: [v for _, v in got(spark, S.ReductionSeries(r, many, **k))]
    assert run("sum") == [9, 9]
    assert run("avg", partial=True) == [3, 3, 7]
    assert run("first") == [1, 2]
    assert run("last") == [5, 1]
    assert run("p50") == [3, 2]
    assert run("count", partial=True) == [3, 3, 1]
    assert got(spark, S.ReductionSeries("avg", S.ListSeries((series({0: 3}, data_type="integer"),)))) == [(0, 3.0)]


def test_reduction_errors_and_fallback(spark):
    with pytest.raises(QueryError):
        got(spark, S.ReductionSeries("sum", S.ListSeries(())))
    with pytest.raises(QueryError):
        got(spark, S.ReductionSeries("sum", S.ListSeries(()), None, None, E.Constant(1, "decimal")))
    with pytest.raises(QueryError):
        got(spark, S.ReductionSeries("sum", S.ListSeries((series({0: 1.0}), series({0: 1}, data_type="integer")))))
    with pytest.raises(QueryError):
        got(spark, S.ReductionSeries("sum", S.ListSeries((series({0: 1.0}), series({0: 1.0}, required=False)))))
    empty = S.ReductionSeries("sum", S.ListSeries(()), S.Aligner(MINUTE), NewField("none"), E.Constant(1, "decimal"))
    assert got(spark, empty, start=at(30), end=at(180)) == [(0, 1), (60, 1), (120, 1)]


def test_schedules(spark):
    rows = {3600 * h: float(h) for h in range(24 * 10)}  # from Wednesday, 1 January 2025
    hours = lambda *f, **k: [v for _, v in got(spark, series(rows), S.ScheduleFilter(Schedule(*f, **k)))]
    night = ScheduleCondition((TimeSlot(22, 0, 2, 0),))
    assert [v for v in hours((night,)) if v < 48] == [0, 1, 22, 23, 24, 25, 46, 47]
    assert {v // 24 for v in hours((ScheduleCondition(weekdays=(0, 6)),))} == {3, 4}
    assert hours(()) == []
    assert {v // 24 for v in hours((ScheduleCondition(periods=(YearPeriod(12, 30, 1, 2),)),))} == {0, 1}
    assert len(hours((ScheduleCondition(dates=("2025-01-03",)), night), (ScheduleCondition(dates=("2025-01-03",)),))) == 4 * 9
    assert hours((night,), start=at(3600), end=at(7200)) == [1]
    assert hours((ScheduleCondition((TimeSlot(0, 0, 1, 0),)),), zone="Etc/GMT-1")[:1] == [23]
    for wrong in ((1, 0, 1, 0), (24, 0, 1, 0)):
        with pytest.raises(QueryError):
            TimeSlot(*wrong)
    with pytest.raises(QueryError):
        YearPeriod(2, 30, 3, 1)
    with pytest.raises(QueryError):
        ScheduleCondition(weekdays=(7,))
    with pytest.raises(QueryError):
        Schedule(zone="Nowhere")


def test_schedule_windows(spark):
    s = Schedule((ScheduleCondition((TimeSlot(9, 30, 10, 0), TimeSlot(10, 0, 10, 45)), (1, 2, 3, 4, 5)),))
    start, end = datetime(2025, 1, 3), datetime(2025, 1, 7)
    rows = [(str(a), str(b)) for a, b in s.active_windows(spark, start, end).collect()]
    assert rows == [(f"2025-01-0{d} 09:30:00", f"2025-01-0{d} 10:45:00") for d in (3, 6)]
    assert s.total_seconds(spark, start, end) == 2 * 75 * 60
    assert str(s.next_match(spark, datetime(2025, 1, 3, 12), end)) == "2025-01-06 09:30:00"
    assert not s.matches_period(spark, datetime(2025, 1, 4), datetime(2025, 1, 6))


def test_filter_hook_stops_at_the_first_refusal(spark):
    taken = []

    class Source(S.Datasource):
        def __init__(self, left):
            self.left = left

        def run(self, spark, start=None, end=None):
            return series({0: 1.0}).run(spark)

        def try_filter(self, one):
            if not self.left:
                return None
            taken.append(one)
            return Source(self.left - 1)

    shifts = tuple(S.TimeShift(s) for s in (1, 2, 3))
    assert got(spark, Source(1), *shifts) == [(5, 1)]
    assert taken == [shifts[0]]


def test_durations():
    assert duration_us("1h30m") == 5_400_000_000
    assert duration_us("250ms") == 250_000
    assert duration_text(5_400_000_000) == "1h30m"
    for wrong in ("", "5", "5 m", "m5"):
        with pytest.raises(QueryError):
            duration_us(wrong)


def test_metadata(spark):
    found = S.Aligner(MINUTE, reduction="count").apply(series({0: 1.0}, unit="kWh").run(spark)).meta
    assert (found.data_type, found.unit, found.sample_period) == ("integer", "", 60_000_000)
    found = S.OverrideMeta(unit="W", kind="rate").apply(series({0: 1.0}, unit="kWh", custom={"a": 1}).run(spark))
    assert (found.meta.unit, found.meta.kind, found.meta.custom) == ("W", "rate", {"a": 1})
    assert found.result().schema["value"].metadata["unit"] == "W"
    with pytest.raises(QueryError):
        FieldMeta("decimal", urn="")
    with pytest.raises(QueryError):
        FieldMeta("number", urn="x")
    with pytest.raises(QueryError):
        FieldMeta("decimal", kind="speed", urn="x")
