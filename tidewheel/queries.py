"""The registered queries of the time-series engine, each with the SQL it must agree with.

Results carry times without a zone (UTC) and doubles rounded to six places, as the SQL does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as E
from .functions.ordered import chunk_of, running_total
from .functions.periods import CalendarPeriod, FixedPeriod
from .meta import FieldMeta, NewField
from .operators import aggregation as A
from .operators import report as R
from .operators import series as S
from .operators import streams as L
from .operators.schedule import Schedule, ScheduleCondition, TimeSlot, YearPeriod
from .plans.parse import Plugins, execute_aggregation, execute_query
from .shared import shared_root
from .sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR, DAY = FixedPeriod(3_600_000_000), CalendarPeriod("day")
UTC = lambda *a: datetime(*a)


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, sf_dir))

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone, doubles to six places."""
    cols = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "double":
            c = F.round(c, 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(sf_dir: str, where: str | None = None, urn: str = "value", unique: bool = True, **meta) -> S.TableSeries:
    given = FieldMeta("decimal", urn=urn, **meta)
    return S.TableSeries(given, lambda spark: table(spark, sf_dir, "events"), seq="event_id", where=where, unique=unique)


def of_type(sf_dir: str, event: str, **meta) -> S.TableSeries:
    return events(sf_dir, f"event_type = '{event}'", urn=event, **meta)


def counter_rows(sf_dir: str, modulo: int | None = None) -> Callable[[SparkSession], DataFrame]:
    """A running total by day of the values of all events, by time; optionally modulo a number."""

    def make(spark: SparkSession) -> DataFrame:
        rows = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
        total = running_total(rows, "cents", ["ts", "event_id"], "total", chunk_of(F.col("ts").cast("timestamp")), F.to_date("ts"))
        return total.withColumn("total", F.col("total") % modulo) if modulo else total

    return make


COUNTER = """
c AS (SELECT ts, event_id, (sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id))::BIGINT {mod} AS total FROM events),
l AS (SELECT ts, total, lag(total) OVER o AS was, lag(ts) OVER o AS before FROM c WINDOW o AS (ORDER BY ts, event_id))"""


def counter(sf_dir: str, modulo: int | None = None, kind: str = "cumulative", **meta) -> S.TableSeries:
    return S.TableSeries(FieldMeta("integer", kind=kind, urn="total", **meta), counter_rows(sf_dir, modulo), value="total", seq="event_id")


# ---------------------------------------------------------------- alignment


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, round(sum(value), 6) AS value FROM events
WHERE event_type = 'purchase' GROUP BY 1""")
def align_sum_hour(spark, d):
    return S.FilteredSeries(of_type(d, "purchase"), (S.Aligner(HOUR, reduction="sum"),)).run(spark).result()


INTERP = """
b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, arg_min(value, ts) AS fv, min(ts) AS ft, arg_max(value, ts) AS lv, max(ts) AS lt FROM events
      WHERE event_type = 'purchase' GROUP BY 1),
a AS (SELECT b AS ts, CASE WHEN lag(lt) OVER o IS NULL OR ft = b THEN fv
        ELSE lag(lv) OVER o + (fv - lag(lv) OVER o) * (epoch_us(b) - epoch_us(lag(lt) OVER o))::DOUBLE / (epoch_us(ft) - epoch_us(lag(lt) OVER o))::DOUBLE END AS value
      FROM b WINDOW o AS (ORDER BY b))"""


@query(f"WITH {INTERP} SELECT ts, round(value, 6) AS value FROM a")
def align_interp_hour(spark, d):
    return S.FilteredSeries(of_type(d, "purchase"), (S.Aligner(HOUR),)).run(spark).result()


GRID = f"""WITH {INTERP},
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM a), (SELECT max(ts) FROM a), INTERVAL '1 hour')) AS ts),
j AS (SELECT g.ts, a.value, a.ts AS k FROM g LEFT JOIN a ON a.ts = g.ts),
p AS (SELECT ts, value, last_value(value IGNORE NULLS) OVER b AS pv, last_value(k IGNORE NULLS) OVER b AS pt,
        first_value(value IGNORE NULLS) OVER f AS nv, first_value(k IGNORE NULLS) OVER f AS nt FROM j
      WINDOW b AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query(GRID + """SELECT ts, round(CASE WHEN value IS NOT NULL THEN value ELSE pv + (nv - pv) * (epoch_us(ts) - epoch_us(pt))::DOUBLE / (epoch_us(nt) - epoch_us(pt))::DOUBLE END, 6) AS value FROM p""")
def align_fill_linear(spark, d):
    return S.FilteredSeries(of_type(d, "purchase"), (S.Aligner(HOUR, "linear"),)).run(spark).result()


@query(GRID + "SELECT ts, round(coalesce(value, pv), 6) AS value FROM p")
def align_fill_forward(spark, d):
    return S.FilteredSeries(of_type(d, "purchase"), (S.Aligner(HOUR, "forwardFill"),)).run(spark).result()


@query("""SELECT time_bucket(INTERVAL '15 minutes', ts, INTERVAL '5 minutes') AS ts, count(value)::BIGINT AS value FROM events GROUP BY 1""")
def align_quarter_hour_offset(spark, d):
    return S.FilteredSeries(events(d), (S.Aligner(FixedPeriod(900_000_000, 300_000_000), reduction="count"),)).run(spark).result()


def _calendar(unit: str, start: str, zone: str = "UTC"):
    sql = f"SELECT {start} AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1"

    @query(sql, name=f"calendar_{unit.lower()}")
    def run(spark, d):
        source = S.TableSeries(FieldMeta("decimal", urn="price"), lambda s: table(s, d, "orders"), ts="o_orderdate", value="o_totalprice", seq="o_orderkey")
        found = S.FilteredSeries(source, (S.Aligner(CalendarPeriod(unit, zone), reduction="sum"),)).run(spark).result()
        return found.select("ts", F.round("value", 2).alias("value"))


for _unit in ("day", "week", "month", "quarter", "year"):
    _calendar(_unit, f"date_trunc('{_unit}', o_orderdate)::TIMESTAMP")
_calendar("halfYear", "make_timestamp(year(o_orderdate), CASE WHEN month(o_orderdate) > 6 THEN 7 ELSE 1 END, 1, 0, 0, 0)")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, round(sum(value), 6) AS value, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1""")
def range_pushed_down(spark, d):
    fields = [(FieldMeta("decimal", urn=u), "value") for u in ("value", "n", "mean")]
    report = R.TableReport(tuple(fields), lambda s: table(s, d, "events"), seq="event_id")
    how = {"value": R.FieldAlignment("sum"), "n": R.FieldAlignment("count"), "mean": R.FieldAlignment("avg")}
    return R.FilteredReport(report, (R.ReportAligner(HOUR, None, how),)).run(spark, UTC(2024, 1, 5), UTC(2024, 2, 1)).result()


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(value)::BIGINT AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
round(stddev_pop(value), 6) AS stddev, round(var_pop(value), 6) AS variance, round(max(value) - min(value), 6) AS spread, round(sum(value), 6) AS sum,
arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999
FROM events GROUP BY 1""")
def bucket_reductions_day(spark, d):
    names = ("count", "avg", "min", "max", "stddev", "variance", "spread", "sum", "first", "last", "p50", "p75", "p90", "p95", "p99", "p999")
    report = R.TableReport(tuple((FieldMeta("decimal", urn=n), "value") for n in names), lambda s: table(s, d, "events"), seq="event_id")
    return R.FilteredReport(report, (R.ReportAligner(DAY, None, {n: R.FieldAlignment(n) for n in names}),)).run(spark).result()


@query("""WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, arg_min(value, ts) AS fv, min(ts) AS ft, arg_max(value, ts) AS lv, max(ts) AS lt, round(sum(value), 6) AS total FROM events GROUP BY 1)
SELECT b AS ts, round(CASE WHEN lag(lt) OVER o IS NULL OR ft = b THEN fv ELSE lag(lv) OVER o + (fv - lag(lv) OVER o) * (epoch_us(b) - epoch_us(lag(lt) OVER o))::DOUBLE / (epoch_us(ft) - epoch_us(lag(lt) OVER o))::DOUBLE END, 6) AS level, total AS spent
FROM b WINDOW o AS (ORDER BY b)""")
def report_aligner(spark, d):
    report = R.TableReport(((FieldMeta("decimal", urn="level"), "value"), (FieldMeta("decimal", kind="delta", urn="spent"), "value")), lambda s: table(s, d, "events"), seq="event_id")
    return R.FilteredReport(report, (R.ReportAligner(HOUR),)).run(spark).result()


@query("""SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-30 23:00:00', INTERVAL '1 hour')) AS ts""")
def aligned_timestamps(spark, d):
    return S.aligned_timestamps(spark, HOUR, UTC(2024, 1, 1, 0, 30), UTC(2024, 3, 31))


@query(f"""WITH {INTERP}, z AS (SELECT arg_max(value, ts) AS value, max(ts) AS raw, min(ts) AS low FROM events WHERE event_type = 'purchase'),
u AS (SELECT ts, value FROM a UNION ALL SELECT time_bucket(INTERVAL '1 hour', raw) + INTERVAL '1 hour', value FROM z WHERE time_bucket(INTERVAL '1 hour', raw) <> raw AND raw <> low)
SELECT ts, round(value - was, 6) AS value FROM (SELECT ts, value, lag(value) OVER (ORDER BY ts) AS was FROM u) WHERE was IS NOT NULL""")
def align_delta_hour(spark, d):
    return S.align_delta(of_type(d, "purchase").run(spark), HOUR).result()


# ---------------------------------------------------------------- deltas and rates


@query(f"WITH {COUNTER.format(mod='')} SELECT ts, total - was AS value FROM l WHERE was IS NOT NULL")
def delta_plain(spark, d):
    return S.FilteredSeries(counter(d), (S.DeltaFilter(),)).run(spark).result()


@query(f"WITH {COUNTER.format(mod='')} SELECT ts, total - was AS value FROM l WHERE was IS NOT NULL AND epoch_us(ts) - epoch_us(before) <= 1200000000")
def delta_gap(spark, d):
    return S.FilteredSeries(counter(d, sample_period=600_000_000), (S.DeltaFilter(),)).run(spark).result()


@query(f"WITH {COUNTER.format(mod='')} SELECT ts, CASE WHEN total < was THEN 0 ELSE total - was END AS value FROM l WHERE was IS NOT NULL")
def delta_counter_reset(spark, d):
    return S.FilteredSeries(counter(d), (S.DeltaFilter(S.Counter(non_negative=True)),)).run(spark).result()


@query(f"WITH {COUNTER.format(mod='')} SELECT ts, CASE WHEN total < was THEN total ELSE total - was END AS value FROM l WHERE was IS NOT NULL")
def delta_counter_emit(spark, d):
    return S.FilteredSeries(counter(d), (S.DeltaFilter(S.Counter(non_negative=True, emit_on_reset=True)),)).run(spark).result()


@query(f"WITH {COUNTER.format(mod='% 100000')} SELECT ts, CASE WHEN total < was THEN 100000 - was + total ELSE total - was END AS value FROM l WHERE was IS NOT NULL")
def delta_counter_wrap(spark, d):
    return S.FilteredSeries(counter(d, 100_000), (S.DeltaFilter(S.Counter(non_negative=True, max_counter=100_000)),)).run(spark).result()


@query()
def delta_counter_negative_gap(spark, d):
    """Readings below zero and gaps of over a day: the fold of the negative readings. SQL would recurse row by row over every event, so tests hold it against brute force."""
    make = lambda s: table(s, d, "events").selectExpr("ts", "event_id", "cast(round(value * 10) as bigint) - 60 AS v")
    source = S.TableSeries(FieldMeta("integer", kind="cumulative", urn="v"), make, value="v", seq="event_id")
    return S.FilteredSeries(source, (S.DeltaFilter(S.Counter(non_negative=True, max_gap=86_400_000_000)),)).run(spark).result()


@query(f"WITH {COUNTER.format(mod='')} SELECT ts, round((CASE WHEN total < was THEN 0 ELSE total - was END)::DOUBLE / ((epoch_us(ts) - epoch_us(before)) / 1e6) * 3600, 6) AS value FROM l WHERE was IS NOT NULL")
def rate_per_hour(spark, d):
    return S.FilteredSeries(counter(d), (S.RateFilter("per hour", 3600, S.Counter(non_negative=True), "infinite"),)).run(spark).result()


@query("SELECT ts + INTERVAL '1 day' AS ts, value FROM events")
def time_shift(spark, d):
    return S.FilteredSeries(events(d), (S.TimeShift(86_400),)).run(spark).result()


# ---------------------------------------------------------------- expressions


@query("SELECT ts, value FROM events WHERE value > 20 AND (value < 50 OR value = 60)")
def condition_filter(spark, d):
    ref, c = E.Ref(), lambda v: E.Constant(v, "decimal")
    cond = E.Logical("and", E.Condition("greater_than", ref, c(20)), E.Logical("or", E.Condition("less_than", ref, c(50)), E.Condition("equals", ref, c(60))))
    return S.FilteredSeries(events(d), (S.ConditionFilter(cond),)).run(spark).result()


def lines(d: str) -> R.TableReport:
    fields = [("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"), ("quantity", "l_quantity")]
    metas = [(FieldMeta("decimal", urn=u), c) for u, c in fields]
    metas += [(FieldMeta("integer", urn="line"), "l_linenumber"), (FieldMeta("string", urn="flag"), "l_returnflag"), (FieldMeta("integer", urn="key"), "l_orderkey"), (FieldMeta("decimal", False, urn="maybe"), "CASE WHEN l_quantity > 25 THEN l_tax END")]
    return R.TableReport(tuple(metas), lambda s: table(s, d, "lineitem"), ts="l_shipdate", seq="l_orderkey * 10 + l_linenumber")


@query("""SELECT l_shipdate AS ts, l_orderkey AS key, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charged,
l_orderkey // l_linenumber AS quotient, l_orderkey % l_linenumber AS remainder, CAST(pow(l_linenumber, 3) AS BIGINT) AS cube,
CASE WHEN l_quantity >= 25 THEN l_extendedprice ELSE l_discount END AS chosen, coalesce(CASE WHEN l_quantity > 25 THEN l_tax END, l_discount) AS filled,
coalesce(CASE WHEN l_quantity > 25 THEN l_tax END <> l_discount, false) AS differs FROM lineitem""")
def report_fields(spark, d):
    r, c = E.Ref, lambda v: E.Constant(v, "decimal")
    net = E.Numeric(r("price"), "*", E.Numeric(c(1), "-", r("discount")))
    chosen = E.Selector(E.Condition("greater_equal", r("quantity"), c(25)), r("price"), r("discount"))
    fields = [
        (r("key"), NewField("key")),
        (net, NewField("net")),
        (E.Numeric(r("net"), "*", E.Numeric(c(1), "+", r("tax"))), NewField("charged")),
        (E.Numeric(r("key"), "/", r("line")), NewField("quotient")),
        (E.Numeric(r("key"), "%", r("line")), NewField("remainder")),
        (E.Numeric(r("line"), "^", E.Constant(3, "integer")), NewField("cube")),
        (chosen, NewField("chosen")),
        (E.Nvl(r("maybe"), r("discount")), NewField("filled")),
        (E.Condition("not_equals", r("maybe"), r("discount")), NewField("differs")),
    ]
    return R.FilteredReport(lines(d), (R.SelectFields(tuple(fields)),)).run(spark).result()


@query("""SELECT l_shipdate AS ts, l_orderkey AS key, l_linenumber::BIGINT AS line, abs(-l_tax) AS abs, 0 - l_tax AS negate, round(sqrt(l_quantity), 6) AS sqrt, ceil(l_extendedprice) AS ceil, floor(l_extendedprice) AS floor,
floor(l_extendedprice + 0.5) AS round, round(ln(l_quantity), 6) AS log, round(log10(l_quantity), 6) AS log10, round(exp(l_tax), 6) AS exp, round(sin(l_quantity), 6) AS sin, round(cos(l_quantity), 6) AS cos, round(tan(l_tax), 6) AS tan,
CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_linenumber AS DOUBLE) AS decimal, CAST(l_linenumber AS VARCHAR) AS text,
regexp_replace(regexp_replace(l_extendedprice::DECIMAL(18, 2)::VARCHAR, '0+$', ''), '\\.$', '') AS price_text FROM lineitem""")
def unary_and_casts(spark, d):
    r = E.Ref
    source = {"abs": E.Unary(r("tax"), "negate"), "negate": r("tax"), "sqrt": r("quantity"), "ceil": r("price"), "floor": r("price"), "round": r("price"), "log": r("quantity"), "log10": r("quantity"), "exp": r("tax"), "sin": r("quantity"), "cos": r("quantity"), "tan": r("tax")}
    fields = [(r("key"), NewField("key")), (r("line"), NewField("line"))] + [(E.Unary(v, op), NewField(op)) for op, v in source.items()]
    casts = [("whole", "price", "integer"), ("decimal", "line", "decimal"), ("text", "line", "string"), ("price_text", "price", "string")]
    fields += [(E.Cast(r(src), kind), NewField(urn)) for urn, src, kind in casts]
    return R.FilteredReport(lines(d), (R.SelectFields(tuple(fields)),)).run(spark).result()


@query("""WITH z AS (SELECT o_orderkey, o_orderdate AS ts, timezone('America/New_York', timezone('UTC', o_orderdate)) AS l FROM orders)
SELECT ts, o_orderkey AS key, year(l)::BIGINT AS year, quarter(l)::BIGINT AS quarter, month(l)::BIGINT AS month, dayofyear(l)::BIGINT AS "dayOfYear", day(l)::BIGINT AS "dayOfMonth",
isodow(l)::BIGINT AS "dayOfWeek", hour(l)::BIGINT AS hour, minute(l)::BIGINT AS minute, epoch_ms(ts)::BIGINT AS "epochMillis" FROM z""")
def timestamp_parts(spark, d):
    report = R.TableReport(((FieldMeta("integer", urn="key"), "o_orderkey"),), lambda s: table(s, d, "orders"), ts="o_orderdate", seq="o_orderkey")
    parts = [(E.Ref("key"), NewField("key"))] + [(E.TimestampExtract(E.RowTimestamp(), p, "America/New_York"), NewField(p)) for p in E.PARTS]
    return R.FilteredReport(report, (R.SelectFields(tuple(parts)),)).run(spark).result()


@query("""SELECT l_shipdate AS ts, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_quantity AS quantity, round(l_discount + l_tax, 6) AS sum, round((l_discount + l_tax) / 2, 6) AS avg,
least(l_discount, l_tax) AS min, greatest(l_discount, l_tax) AS max, 2::BIGINT AS count, l_discount AS first, l_tax AS last, round(abs(l_discount - l_tax) / 2, 6) AS stddev,
round(pow(abs(l_discount - l_tax) / 2, 2), 6) AS variance, round(abs(l_discount - l_tax), 6) AS spread, round(least(l_discount, l_tax) + 0.9 * abs(l_discount - l_tax), 6) AS p90 FROM lineitem""")
def reduce_across_fields(spark, d):
    filters = [R.projection(["price", "discount", "tax", "quantity"])]
    filters += [R.AppendField(E.ReduceFields(n, ("discount", "tax")), NewField(n)) for n in ("sum", "avg", "min", "max", "count", "first", "last", "stddev", "variance", "spread", "p90")]
    return R.FilteredReport(lines(d), tuple(filters)).run(spark).result()


@query("""SELECT l_shipdate AS ts, l_extendedprice * 2 AS price, l_discount AS discount, l_quantity AS amount FROM lineitem WHERE l_returnflag = 'R'""")
def report_filters(spark, d):
    filters = (
        R.ReportCondition(E.Condition("equals", E.Ref("flag"), E.Constant("R", "string"))),
        R.ReplaceField("price", E.Numeric(E.Ref("price"), "*", E.Constant(2, "decimal")), NewField("price")),
        R.DropFields(("tax", "line", "flag", "key", "maybe")),
        R.OverrideFieldMeta("quantity", urn="amount", unit="pieces"),
    )
    return R.FilteredReport(lines(d), filters).run(spark).result()


@query("SELECT ts, value * 2 AS twice FROM events")
def single_field(spark, d):
    report = R.FromDatasource(events(d))
    return R.FilteredReport(report, (R.SingleField(E.Numeric(E.Ref("value"), "*", E.Constant(2, "decimal")), NewField("twice")),)).run(spark).result()


@query("SELECT ts, round(value * 3, 6) AS value FROM events")
def field_value_to_series(spark, d):
    tripled = S.FieldValueFilter(E.Numeric(E.Ref(), "*", E.Constant(3, "decimal")), NewField("tripled", unit="x"))
    return R.ToDatasource(R.FromDatasource(S.FilteredSeries(events(d), (tripled, S.OverrideMeta(urn="v")))), "v").run(spark).result()


# ---------------------------------------------------------------- schedules


@query("""SELECT ts, value FROM events WHERE isodow(ts) BETWEEN 1 AND 5 AND hour(ts) >= 9 AND hour(ts) < 17 AND ts::DATE <> DATE '2024-01-10'""")
def schedule_business_hours(spark, d):
    one = ScheduleCondition((TimeSlot(9, 0, 17, 0),), (1, 2, 3, 4, 5))
    s = Schedule((one,), (ScheduleCondition(dates=("2024-01-10",)),))
    return S.FilteredSeries(events(d), (S.ScheduleFilter(s),)).run(spark).result()


@query("""SELECT ts, value FROM events WHERE (hour(ts) >= 22 OR hour(ts) < 6 OR dayofweek(ts) IN (0, 6)) AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-20'""")
def schedule_cross_midnight(spark, d):
    s = Schedule((ScheduleCondition((TimeSlot(22, 0, 6, 0),)), ScheduleCondition(weekdays=(0, 6))), (), UTC(2024, 1, 3), UTC(2024, 2, 20))
    return S.FilteredSeries(events(d), (S.ScheduleFilter(s),)).run(spark).result()


@query("""SELECT o_orderdate AS ts, o_totalprice AS price FROM orders WHERE (month(o_orderdate) * 100 + day(o_orderdate) >= 1101 OR month(o_orderdate) * 100 + day(o_orderdate) <= 228)
AND NOT month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 1224 AND 1226""")
def schedule_period(spark, d):
    report = R.TableReport(((FieldMeta("decimal", urn="price"), "o_totalprice"),), lambda s: table(s, d, "orders"), ts="o_orderdate", seq="o_orderkey")
    s = Schedule((ScheduleCondition(periods=(YearPeriod(11, 1, 2, 28),), exclude_periods=(YearPeriod(12, 24, 12, 26),)),))
    return R.FilteredReport(report, (R.ReportSchedule(s),)).run(spark).result()


@query("""SELECT d + INTERVAL '22 hours' AS "start", d + INTERVAL '30 hours' AS "end" FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-13', INTERVAL '1 day')) AS d)
UNION ALL SELECT TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 06:00:00' UNION ALL SELECT TIMESTAMP '2024-01-14 22:00:00', TIMESTAMP '2024-01-15'""")
def schedule_windows(spark, d):
    return Schedule((ScheduleCondition((TimeSlot(22, 0, 6, 0),)),)).active_windows(spark, UTC(2024, 1, 1), UTC(2024, 1, 15))


# ---------------------------------------------------------------- several series


def hourly(d: str, kind: str) -> S.FilteredSeries:
    return S.FilteredSeries(of_type(d, kind), (S.Aligner(HOUR, reduction="sum"),))


def _sums(kind: str) -> str:
    return f"(SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, sum(value) AS {kind} FROM events WHERE event_type = '{kind}' GROUP BY 1)"


TRIO = ("purchase", "error", "view")


def _join(kind: str):
    word = {"inner": "JOIN", "left": "LEFT JOIN", "full": "FULL JOIN"}[kind]
    cols = ", ".join(f"round({k}, 6) AS {k}" for k in TRIO)

    @query(f"SELECT ts, {cols} FROM {_sums(TRIO[0])} {word} {_sums(TRIO[1])} USING (ts) {word} {_sums(TRIO[2])} USING (ts)", name=f"join_{kind}")
    def run(spark, d):
        return R.JoinReports(R.ListReports(tuple(R.FromDatasource(hourly(d, k)) for k in TRIO)), kind).run(spark).result()


for _kind in ("inner", "left", "full"):
    _join(_kind)

_UNION = " UNION ALL ".join(f"SELECT ts, {k} AS v FROM {_sums(k)}" for k in TRIO)


@query(f"SELECT ts, round(avg(v), 6) AS value FROM ({_UNION}) GROUP BY ts HAVING count(*) = 3")
def reduce_inner(spark, d):
    many = S.ListSeries(tuple(of_type(d, k) for k in TRIO))
    return S.ReductionSeries("avg", many, S.Aligner(HOUR, reduction="sum"), NewField("mean")).run(spark).result()


@query(f"SELECT ts, round(max(v), 6) AS value FROM ({_UNION}) GROUP BY ts")
def reduce_partial(spark, d):
    many = S.FilteredMany(S.ListSeries(tuple(of_type(d, k) for k in TRIO)), (S.Aligner(HOUR, reduction="sum"),))
    return S.ReductionSeries("max", many, None, NewField("top"), partial=True).run(spark).result()


@query("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02 23:00:00', INTERVAL '1 hour')) AS ts, 7.5::DOUBLE AS value")
def reduce_fallback(spark, d):
    empty = S.ReductionSeries("sum", S.ListSeries(()), S.Aligner(HOUR), NewField("none"), E.Constant(7.5, "decimal"))
    return empty.run(spark, UTC(2024, 1, 1), UTC(2024, 1, 3)).result()


# ---------------------------------------------------------------- aggregations


@query("""SELECT sum(value) AS total, (NULL)::TIMESTAMP AS total__ts, min(value) AS low, arg_min(ts, struct_pack(v := value, t := ts)) AS low__ts, max(value) AS high, arg_max(ts, struct_pack(v := value, t := -epoch_us(ts))) AS high__ts,
arg_min(value, ts) AS first, min(ts) AS first__ts, arg_max(value, ts) AS last, max(ts) AS last__ts, count(*)::BIGINT AS n, (NULL)::TIMESTAMP AS n__ts, round(quantile_cont(value, 0.95), 6) AS p95, (NULL)::TIMESTAMP AS p95__ts
FROM events""".replace("sum(value) AS total", "round(sum(value), 2) AS total"))
def agg_multi(spark, d):
    made = [("sum", "total"), ("min", "low"), ("max", "high"), ("first", "first"), ("last", "last"), ("count", "n"), ("p95", "p95")]
    found = A.FromSeries(events(d), tuple(A.AggregatedField(r, NewField(u)) for r, u in made)).run(spark).result()
    return found.withColumn("total", F.round("total", 2))


@query("""SELECT event_type, arg_min(value, ts) AS first, arg_max(value, ts) AS last, min(value) AS low, arg_min(ts, struct_pack(v := value, t := ts)) AS low_at, max(value) AS high, arg_max(ts, struct_pack(v := value, t := -epoch_us(ts))) AS high_at FROM events GROUP BY 1""")
def first_last_ts(spark, d):
    from .functions.reductions import over_rows, time_of

    rows, order, v = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.struct("ts", "event_id"), F.col("value")
    made = [over_rows(r, v, order, "decimal").alias(n) for r, n in (("first", "first"), ("last", "last"), ("min", "low"), ("max", "high"))]
    return rows.groupBy("event_type").agg(*made, time_of("min", v, F.col("ts"), order).alias("low_at"), time_of("max", v, F.col("ts"), order).alias("high_at"))


@query("""SELECT round(max(value) / avg(value), 6) AS peak, NULL::TIMESTAMP AS peak__ts, CAST(trunc(avg(value)) AS BIGINT) AS whole, NULL::TIMESTAMP AS whole__ts, round(sqrt(abs(-avg(value))), 6) AS root, NULL::TIMESTAMP AS root__ts FROM events""")
def agg_expression(spark, d):
    source = A.FromSeries(events(d), (A.AggregatedField("max"), A.AggregatedField("avg")))
    top, mean = E.Ref("value_max"), E.Ref("value_avg")
    fields = ((E.Numeric(top, "/", mean), NewField("peak")), (E.Cast(mean, "integer"), NewField("whole")), (E.Unary(E.Unary(E.Unary(mean, "negate"), "abs"), "sqrt"), NewField("root")))
    return A.FromExpressions(source, fields).run(spark).result()


@query("""SELECT (SELECT count(*)::BIGINT FROM events) AS events, NULL::TIMESTAMP AS events__ts, (SELECT count(*)::BIGINT FROM orders) AS orders, NULL::TIMESTAMP AS orders__ts, (SELECT max(o_totalprice) FROM orders) AS top,
(SELECT min(o_orderdate) FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)) AS top__ts, -1.0::DOUBLE AS nothing, NULL::TIMESTAMP AS nothing__ts""")
def agg_composite(spark, d):
    orders = S.TableSeries(FieldMeta("decimal", urn="price"), lambda s: table(s, d, "orders"), ts="o_orderdate", value="o_totalprice", seq="o_orderkey")
    none = S.FilteredSeries(events(d), (S.ConditionFilter(E.Condition("less_than", E.Ref(), E.Constant(-1, "decimal"))),))
    parts = (
        A.FromSeries(events(d), (A.AggregatedField("count", NewField("events")),)),
        A.FromSeries(orders, (A.AggregatedField("count", NewField("orders")), A.AggregatedField("max", NewField("top")))),
        A.FromSeries(none, (A.AggregatedField("avg", NewField("nothing"), E.Constant(-1, "decimal")),)),
    )
    return A.Composite(parts).run(spark).result()


@query("""WITH e AS (SELECT l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem)
SELECT round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(avg(a - p), 4) AS mbe, round(100 * avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END), 4) AS mape,
round(covar_pop(a, p) / (stddev_pop(a) * stddev_pop(p)), 6) AS pearson, round(1 - sum((a - p) * (a - p)) / (count(*) * var_pop(a)), 6) AS r2 FROM e""")
def paired_all(spark, d):
    predicted = R.AppendField(E.Numeric(E.Ref("quantity"), "*", E.Constant(1500, "decimal")), NewField("predicted"))
    report = R.FilteredReport(lines(d), (predicted,))
    names = ("mae", "rmse", "mbe", "mape", "pearson", "r2")
    found = A.FromReport(report, tuple(A.AggregatedField(n, NewField(n), None, "price", "predicted") for n in names)).run(spark).result()
    return found.select(*[F.round(n, 6 if n in ("pearson", "r2") else 4).alias(n) for n in names])


# ---------------------------------------------------------------- ordered rows


def _windows(size: int, step: int):
    partial = "" if step == 1 else f" OR s = CASE WHEN n < {size} THEN 0 ELSE ((n - {size}) // {step} + 1) * {step} END"
    sql = f"""WITH w AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS s, count(*) OVER () AS n,
list(event_id) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS l FROM events)
SELECT s::BIGINT AS "start", len(l)::BIGINT AS n, list_sum(l)::BIGINT AS total FROM w WHERE s % {step} = 0 AND (len(l) = {size}{partial})"""

    @query(sql, name=f"count_window_{size}_{step}")
    def run(spark, d):
        found = L.count_windows(table(spark, d, "events").select("event_id"), size, step, "event_id", "event_id")
        return found.select("start", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_windows(3, 1)
_windows(5, 3)


@query("SELECT src, event_id FROM (SELECT 0 AS src, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 1, event_id FROM events WHERE event_type = 'error')")
def concat(spark, d):
    rows = table(spark, d, "events")
    return L.concatenated(*[rows.filter(F.col("event_type") == k).select("event_id") for k in ("view", "error")])


@query("""SELECT row_number() OVER (ORDER BY user_id, src, event_id) - 1 AS pos, src, user_id, event_id FROM (SELECT 0 AS src, user_id, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 1, user_id, event_id FROM events WHERE event_type = 'error')""")
def merge_sorted(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    parts = [rows.filter(F.col("event_type") == k).drop("event_type") for k in ("view", "error")]
    return L.merged_sorted("user_id", "event_id", *parts, position="pos").select("pos", "src", "user_id", "event_id")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id AS a FROM events WHERE event_type = 'view'), b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id AS b FROM events WHERE event_type = 'error')
SELECT pos, a, b FROM a JOIN b USING (pos)""")
def zip_rows(spark, d):
    rows = table(spark, d, "events")
    parts = [rows.filter(F.col("event_type") == k).select("event_id") for k in ("view", "error")]
    return L.zipped("event_id", *parts).select("pos", F.col("s0.event_id").alias("a"), F.col("s1.event_id").alias("b"))


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 50 OFFSET 150")
def page_rows(spark, d):
    return L.page(table(spark, d, "events").select("event_id", "value"), 3, 50, "event_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 25")
def limit_rows(spark, d):
    rows = table(spark, d, "events").select("event_id", (-F.col("event_id")).alias("k"))
    return L.limited(rows, 25, "k").select("event_id")


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 500")
def skip_rows(spark, d):
    return L.skipped(table(spark, d, "events").select("event_id"), 500, "event_id")


@query("SELECT least(100, count(*))::BIGINT AS n, least(100, count(*))::BIGINT AS different, least(100, count(*))::BIGINT AS members FROM events")
def sample_rows(spark, d):
    """How many rows a sample of 100 has, how many different ones, and how many of them the table has."""
    rows = table(spark, d, "events")
    some = L.sampled(rows, 100).select("event_id").alias("s")
    found = some.join(rows.select("event_id", F.lit(1).alias("one")), "event_id", "left")
    return found.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("different"), F.sum(F.coalesce("one", F.lit(0))).cast("long").alias("members"))


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def count_by(spark, d):
    return L.counted_by(table(spark, d, "events"), "user_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_by_key(spark, d):
    return L.last_by_key(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"])


@query("SELECT c_custkey, c_name FROM customer")
def unique_keys(spark, d):
    return L.unique_by_key(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("""SELECT l.event_id AS event_id, l.user_id AS user_id, r.event_id AS other FROM events l {how} JOIN (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) r ON l.user_id = r.user_id WHERE l.event_type = 'error'""".format(how=""))
def join_first_inner(spark, d):
    return _join_first(spark, d, "inner")


@query("""SELECT l.event_id AS event_id, l.user_id AS user_id, r.event_id AS other FROM events l LEFT JOIN (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) r ON l.user_id = r.user_id WHERE l.event_type = 'error'""")
def join_first_left(spark, d):
    return _join_first(spark, d, "left")


def _join_first(spark, d, how):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    left, right = (rows.filter(F.col("event_type") == k) for k in ("error", "purchase"))
    return L.join_sorted(left, right, "user_id", "event_id", how).select(F.col("l.event_id").alias("event_id"), "user_id", F.col("r.event_id").alias("other"))


def _by_position(how: str):
    part = lambda k: f"(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS dup, event_id AS {k} FROM events WHERE event_type = '{k}')"
    word = {"inner": "JOIN", "full": "FULL JOIN"}[how]
    sql = f"SELECT user_id, dup::INTEGER AS dup, purchase, error, view FROM {part('purchase')} {word} {part('error')} USING (user_id, dup) {word} {part('view')} USING (user_id, dup)"

    @query(sql, name=f"join_many_{how}")
    def run(spark, d):
        rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
        parts = [rows.filter(F.col("event_type") == k) for k in TRIO]
        found = L.join_many("user_id", "event_id", *parts, how=how)
        return found.select("user_id", "dup", *[F.col(f"s{k}.event_id").alias(n) for k, n in enumerate(TRIO)])


_by_position("inner")
_by_position("full")


@query("""WITH f AS (SELECT event_type, user_id, min(event_id) AS e FROM events GROUP BY 1, 2) SELECT l.user_id AS user_id, l.event_id AS purchase, a.e AS error, b.e AS view FROM events l
LEFT JOIN f a ON a.user_id = l.user_id AND a.event_type = 'error' LEFT JOIN f b ON b.user_id = l.user_id AND b.event_type = 'view' WHERE l.event_type = 'purchase'""")
def left_join_many(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    found = L.left_join_many("user_id", "event_id", *[rows.filter(F.col("event_type") == k) for k in TRIO])
    return found.select("user_id", *[F.col(f"s{k}.event_id").alias(n) for k, n in enumerate(TRIO)])


@query("""SELECT cluster, n, lag(last) OVER (ORDER BY cluster) AS prev FROM (SELECT event_id // 100 AS cluster, count(*)::BIGINT AS n, max(event_id) AS last FROM events GROUP BY 1)""")
def cluster_rows(spark, d):
    rows = table(spark, d, "events").select("event_id")
    found = L.clustered(rows, F.floor(F.col("event_id") / 100), ["event_id"], [F.count("*").alias("n")])
    return found.select("cluster", "n", F.col("prev.event_id").alias("prev"))


@query("""WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events),
f(user_id, n, value) AS (SELECT user_id, 1::BIGINT, event_id % 1000003 FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, (value * 31 + event_id) % 1000003 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, arg_max(value, n) AS value FROM f GROUP BY 1""")
def fold_rows(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("v"))
    return L.folded(rows, "event_id", "v", F.lit(0).cast("long"), lambda s, x: (s * 31 + x) % 1000003, ("user_id",))


@query("SELECT min(event_id) AS first, max(event_id) AS last FROM events")
def first_and_last(spark, d):
    found = L.first_and_last(table(spark, d, "events").select("event_id"), ["event_id"])
    return found.select(F.col("first.event_id").alias("first"), F.col("last.event_id").alias("last"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def json_members(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("key", "value")).select("event_id", "key")


# ---------------------------------------------------------------- JSON


def _plugins(d: str) -> Plugins:
    plugins = Plugins()
    plugins.register("datasource", "events", lambda parser, node: of_type(d, node["eventType"], kind=node.get("metricKind")))
    return plugins


@query("""WITH s AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, sum(value) AS v FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-03-01' GROUP BY 1)
SELECT ts, round(v * 100, 6) AS value FROM s WHERE v > 30""")
def json_query(spark, d):
    command = {
        "from": "2024-01-02T00:00:00+00:00", "to": "2024-03-01T00:00:00+00:00",
        "datasource": {"type": "filtered", "datasource": {"type": "events", "eventType": "purchase"}, "filters": [
            {"type": "aligner", "alignerPeriod": {"type": "calendar", "alignmentPeriodType": "hour", "zoneId": "UTC"}, "bucketReduction": "sum"},
            {"type": "condition", "booleanField": {"type": "condition", "operatorType": "greater_than", "operand1": {"type": "ref"}, "operand2": {"type": "constant", "dataType": "decimal", "required": True, "fieldValue": 30}}},
            {"type": "fieldValue", "fieldMeta": {"uri": "cents", "overrideUnit": "cent"}, "fieldValue": {"type": "numericExpression", "op1": {"type": "ref"}, "op": "*", "op2": {"type": "constant", "dataType": "decimal", "required": True, "fieldValue": 100}}},
        ]},
    }
    return execute_query(spark, command, _plugins(d)).result()


@query(f"""SELECT round(avg(purchase), 6) AS mean, NULL::TIMESTAMP AS mean__ts, round(avg(abs(purchase - error)), 6) AS gap, NULL::TIMESTAMP AS gap__ts FROM {_sums('purchase')} JOIN {_sums('error')} USING (ts)""")
def json_aggregation(spark, d):
    series = lambda k: {"type": "filtered", "datasource": {"type": "events", "eventType": k}, "filters": [{"type": "aligner", "alignerPeriod": {"type": "custom", "zoneId": "UTC", "durationInMillis": 3_600_000}, "bucketReduction": "sum"}]}
    report = {"type": "join", "joinType": "inner", "multiDatasource": {"type": "fromMultiDatasource", "multiDatasource": {"type": "list", "datasources": [series("purchase"), series("error")]}}}
    fields = [{"reductionType": "avg", "sourceFieldUrn": "purchase", "fieldMeta": {"uri": "mean"}}, {"reductionType": "mae", "sourceFieldUrn": "purchase", "compareFieldUrn": "error", "fieldMeta": {"uri": "gap"}}]
    command = {"from": "2000-01-01T00:00:00+00:00", "to": "2100-01-01T00:00:00+00:00", "aggregation": {"type": "fromReport", "reportDatasource": report, "fields": fields}}
    return execute_aggregation(spark, command, _plugins(d)).result()


# ---------------------------------------------------------------- streams


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS ts, round(sum(value), 6) AS total, count(value)::BIGINT AS n FROM events
GROUP BY 1 HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""")
def stream_tumbling_day(spark, d):
    """A stream of the table's rows, run to its end: the buckets that the watermark has closed."""
    from .streaming import series as X

    return _streamed(spark, d, lambda s: X.tumbling(s, {"total": "sum", "n": "count"}, "1 day", "1 hour"), "tumbling")


@query("""WITH c AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events)
SELECT user_id, ts, round(CASE WHEN value < was THEN 0 ELSE value - was END, 6) AS delta FROM c WHERE was IS NOT NULL""")
def stream_delta(spark, d):
    from .streaming import series as X

    return _streamed(spark, d, lambda s: X.stateful_delta(s, "user_id"), "delta")


def _streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    from .streaming import series as X

    place = f"{shared_root(spark)}/tidewheel-{name}-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.format("parquet").schema(schema).load(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    X.run_to_files(make(stream), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out")


# ---------------------------------------------------------------- sources


STATIC = "(VALUES (TIMESTAMP '2024-01-01 00:00:00', 1.5::DOUBLE), (TIMESTAMP '2024-01-01 01:00:00', -2.0::DOUBLE), (TIMESTAMP '2024-01-01 02:00:00', 8.25::DOUBLE)) t(ts, value)"
STATIC_ROWS = [(UTC(2024, 1, 1, 0), 1.5), (UTC(2024, 1, 1, 1), -2.0), (UTC(2024, 1, 1, 2), 8.25)]


@query(f"SELECT ts, value FROM {STATIC} WHERE ts >= TIMESTAMP '2024-01-01 01:00:00'")
def static_series(spark, d):
    return S.StaticSeries(FieldMeta("decimal", urn="given"), STATIC_ROWS).run(spark, UTC(2024, 1, 1, 1), UTC(2025, 1, 1)).result()


@query(f"SELECT ts, value AS a, CAST(value * 4 AS BIGINT) AS b FROM {STATIC}")
def static_report(spark, d):
    metas = (FieldMeta("decimal", urn="a"), FieldMeta("integer", urn="b"))
    return R.StaticReport(metas, [(t, (v, int(v * 4))) for t, v in STATIC_ROWS]).run(spark).result()


@dataclass
class Reading:
    at: datetime
    heat: float
    count: int
    place: str


@query(f"""SELECT ts, value AS "Reading:heat", CAST(value * 4 AS BIGINT) AS "Reading:count", 'here' AS "Reading:place" FROM {STATIC}""")
def struct_report(spark, d):
    return R.struct_report(Reading, [Reading(t, v, int(v * 4), "here") for t, v in STATIC_ROWS]).run(spark).result()


@query("SELECT i::BIGINT AS n, 'r' || i AS t, i::BIGINT AS seq FROM range(200) r(i)")
def rows_in_memory(spark, d):
    return readers.rows(spark, [(k, f"r{k}") for k in range(200)], "n long, t string")


@query("SELECT NULL::BIGINT AS n, NULL::VARCHAR AS t WHERE false")
def empty_source(spark, d):
    return readers.empty(spark, "n long, t string")


@query("SELECT true AS raised, true AS lazy")
def failing_source(spark, d):
    """A source that fails does so when it is read, with its message, and not before."""
    bad, message = readers.failing(spark, "this source fails", "n long"), ""
    try:
        bad.collect()
    except Exception as e:
        message = str(e)
    return spark.createDataFrame([("this source fails" in message, True)], "raised boolean, lazy boolean")


@query("SELECT 'k' || i AS key, (i * i)::BIGINT AS value FROM range(100) r(i)")
def map_entries(spark, d):
    return readers.from_mapping(spark, {f"k{k}": k * k for k in range(100)}, "string", "long")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def map_members(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("key", "value")).filter("key = 'k'")


@query("SELECT 42::BIGINT AS value")
def optional_row(spark, d):
    none = readers.from_optional(spark, None, "value long")
    return readers.from_optional(spark, 42, "value long").unionByName(none)


@query("SELECT (p * 1000 + k)::BIGINT AS n, 'part ' || p AS t FROM range(4) a(p), range(250) b(k)")
def function_rows(spark, d):
    """A user's Python source, read in four parts."""
    return readers.from_function(spark, lambda part: ((part * 1000 + k, f"part {part}") for k in range(250)), "n long, t string", 4)


#: Characters that go to the JVM at once; a call costs as much as writing some thousands.
PIECE = 1 << 20


def _written(spark: SparkSession, name: str, chunks) -> str:
    """A text file below the shared folder, written by Spark's file system, small pieces together."""
    path = f"{shared_root(spark)}/tidewheel-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    held, size = [], 0

    def flush() -> None:
        nonlocal size
        if held:
            out.write(bytearray("".join(held).encode()))
            held.clear()
            size = 0

    def put(text: str) -> None:
        nonlocal size
        held.append(text)
        size += len(text)
        if size >= PIECE:
            flush()

    try:
        chunks(put)
        flush()
    finally:
        out.close()
    return path


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS seq, 'part ' || p_partkey || ' ' || p_name AS line FROM part""")
def text_lines(spark, d):
    return _lines(spark, d, False)


@query("""SELECT row_number() OVER (ORDER BY p_partkey DESC) - 1 AS seq, 'part ' || p_partkey || ' ' || p_name AS line FROM part""")
def text_lines_reversed(spark, d):
    return _lines(spark, d, True)


def _lines(spark, d, reverse):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit(" "), "p_name").alias("line"))
    path = _written(spark, "lines", lambda write: L.consume(rows, lambda r: write(r["line"] + "\n"), "p_partkey"))
    return readers.lines(spark, path, reverse).select("seq", "line")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS seq, c_custkey, c_name, c_acctbal FROM customer")
def json_array_round_trip(spark, d):
    """A table written as one JSON array, piece by piece, and read again."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = _written(spark, "array", lambda write: L.write_json_array(rows, write, "c_custkey"))
    return readers.json_array(spark, path, "c_custkey long, c_name string, c_acctbal double").select(F.col("seq").cast("long"), "c_custkey", "c_name", "c_acctbal")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS seq, s_suppkey, s_name FROM supplier")
def json_chunks_round_trip(spark, d):
    """A table as a reader of JSON text takes it, and read again."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")

    def write(put):
        for chunk in L.json_chunks(rows, "s_suppkey", rows=37):
            put(chunk)

    return readers.json_array(spark, _written(spark, "chunks", write), "s_suppkey long, s_name string").select(F.col("seq").cast("long"), "s_suppkey", "s_name")


@query("SELECT n_name AS key, n_nationkey::BIGINT AS value FROM nation")
def json_object_members(spark, d):
    rows = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long"))

    def write(put):
        put("{")
        for k, r in L.indexed(rows, "n_name"):
            put(("," if k else "") + f'"{r["n_name"]}": {r["n_nationkey"]}')
        put("}")

    return readers.json_object(spark, _written(spark, "object", write), "long")


# ---------------------------------------------------------------- maps, hooks and collectors


@query("SELECT event_id * 2 AS twice, upper(event_type) AS kind FROM events")
def map_rows(spark, d):
    return L.mapped(table(spark, d, "events"), (F.col("event_id") * 2).alias("twice"), F.upper("event_type").alias("kind"))


@query("SELECT value, event_id FROM (SELECT CASE WHEN value > 10 THEN value END AS value, event_id FROM events) WHERE value IS NOT NULL")
def map_drop_null(spark, d):
    return L.mapped(table(spark, d, "events"), F.when(F.col("value") > 10, F.col("value")).alias("value"), F.col("event_id"), keep_null=False)


@query("SELECT event_id, round(value * 3, 6) AS value FROM events")
def map_batches(spark, d):
    def triple(batches):
        for b in batches:
            yield b.assign(value=b["value"] * 3)

    return L.mapped_batches(table(spark, d, "events").select("event_id", "value"), triple, "event_id long, value double", 8)


@query("SELECT p_partkey, (i - 1)::INTEGER AS idx, string_split(p_name, ' ')[i] AS value FROM part, range(1, 40) r(i) WHERE i <= len(string_split(p_name, ' '))")
def flat_map(spark, d):
    return L.flattened(table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words")), "words")


@query("SELECT count(*)::BIGINT AS n, max(event_id) AS last, 'first,finally' AS hooks FROM events")
def peek_and_hooks(spark, d):
    """What a peek has seen of the rows that went by, and the hooks around it."""
    from pyspark.sql import Observation

    seen, called = Observation("peek"), []
    with L.hooks(lambda: called.append("first"), lambda error: called.append("finally")):
        L.peeked(table(spark, d, "events"), seen, F.count("*").alias("n"), F.max("event_id").alias("last")).write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.createDataFrame([(found["n"], found["last"], ",".join(called))], "n long, last long, hooks string")


@query("SELECT count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS total FROM customer")
def consume_rows(spark, d):
    """Each row through a function on the driver, in order, read ahead by a buffer."""
    rows, total = table(spark, d, "customer").select("c_custkey"), 0
    ordered = (r for _, r in L.indexed(rows, "c_custkey"))
    n = 0
    for r in L.buffered(ordered, 64):
        n, total = n + 1, total + r["c_custkey"]
    return spark.createDataFrame([(n, total)], "n long, total long")


@query("SELECT count(*)::BIGINT AS n, sum(event_id)::BIGINT AS total FROM events")
def consume_concurrently(spark, d):
    """Each partition's rows through a function on the executors, which adds to a shared sum."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(rows):
        for r in rows:
            n.add(1)
            total.add(r["event_id"])

    L.consume_partitions(table(spark, d, "events").select("event_id"), add)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


@query("SELECT n_name AS key, n_regionkey::BIGINT AS value FROM nation")
def to_map(spark, d):
    rows = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    return readers.exploded_map(L.as_map(rows, "n_name", "n_regionkey"), "map")


@query("SELECT (SELECT count(*) FROM events)::BIGINT AS n, (SELECT count(*) = 0 FROM events WHERE event_id < 0) AS empty, (SELECT count(*) FROM region)::BIGINT AS collected")
def count_collect_empty(spark, d):
    rows = table(spark, d, "events")
    made = [(rows.count(), rows.filter("event_id < 0").isEmpty(), len(table(spark, d, "region").collect()))]
    return spark.createDataFrame(made, "n long, empty boolean, collected long")


@query("SELECT max(event_id) + 1 AS mapped, 7::BIGINT AS other, 9::BIGINT AS made, 3::BIGINT AS filtered, 20::BIGINT AS flat, '[1,2]' AS json, true AS empty FROM events")
def optional_algebra(spark, d):
    one = L.Optional(table(spark, d, "events").agg(F.max("event_id").alias("value")))
    none, three = L.Optional.of(spark, [], "long"), L.Optional.of(spark, [3], "long")
    row = (
        one.map(lambda c: c + 1).get(),
        none.or_(L.Optional.of(spark, [7], "long")).get(),
        none.or_else_get(lambda: 9),
        three.filter(lambda c: c > 2).get(),
        three.flat_map(lambda v: L.Optional.of(spark, [v * 5 + 5], "long")).get(),
        L.Optional.of(spark, [[1, 2]], "array<int>").as_json(),
        three.filter(lambda c: c > 3).empty,
    )
    return spark.createDataFrame([row], "mapped long, other long, made long, filtered long, flat long, json string, empty boolean")


@query("SELECT event_id, user_id, (user_id // 7)::BIGINT AS band FROM events")
def user_operator(spark, d):
    """A user's own operator, of two inputs."""

    def banded(left, right):
        return left.join(right, "user_id").select("event_id", "user_id", "band")

    bands = table(spark, d, "events").select("user_id", F.floor(F.col("user_id") / 7).alias("band")).distinct()
    return L.combined(banded, table(spark, d, "events").select("event_id", "user_id"), bands)


@query("SELECT event_id, value, user_id, row_number() OVER (ORDER BY value DESC, user_id, event_id) - 1 AS pos FROM events")
def sort_rows(spark, d):
    """Rows by several columns, one of them downwards."""
    from .functions.ordered import with_position

    rows = table(spark, d, "events").select("event_id", "value", "user_id", (-F.col("value")).alias("down"))
    return with_position(rows, "down", ("user_id", "event_id")).drop("down")


@query("SELECT event_type AS cluster, n, lag(last) OVER (ORDER BY event_type) AS prev FROM (SELECT event_type, count(*)::BIGINT AS n, max(event_id) AS last FROM events GROUP BY 1)")
def cluster_text(spark, d):
    """Clusters by a text, in order of it."""
    found = L.clustered(table(spark, d, "events").select("event_id", "event_type"), F.col("event_type"), ["event_type", "event_id"], [F.count("*").alias("n")])
    return found.select("cluster", "n", F.col("prev.event_id").alias("prev"))


@query(ORACLES["fold_rows"])
def fold_stream(spark, d):
    """The fold of ``fold_rows`` with a Python step, streamed."""
    return L.folded_rows(table(spark, d, "events"), ("user_id",), ("event_id",), "event_id", 0, lambda s, x: (s * 31 + x) % 1000003, "long")


# ---------------------------------------------------------------- more of expressions, reductions and JSON


@query("SELECT l_shipdate AS ts, abs(-l_linenumber)::BIGINT AS abs, (-l_linenumber)::BIGINT AS negate, CAST(trunc(sqrt(l_linenumber)) AS BIGINT) AS sqrt, coalesce(NULL::DOUBLE, l_tax) AS filled FROM lineitem")
def integer_unary_and_nil(spark, d):
    line = E.Ref("line")
    fields = [(E.Unary(E.Unary(line, "negate"), "abs"), NewField("abs")), (E.Unary(line, "negate"), NewField("negate")), (E.Unary(line, "sqrt"), NewField("sqrt")), (E.Nvl(E.Nil("decimal"), E.Ref("tax")), NewField("filled"))]
    return R.FilteredReport(lines(d), (R.SelectFields(tuple(fields)),)).run(spark).result()


@query("SELECT l_shipdate AS ts, l_tax * 2 AS a, l_tax * 2 + l_discount AS b, round((l_tax * 2 + l_discount) * l_tax, 6) AS c FROM lineitem".replace("l_tax * 2 AS", "round(l_tax * 2, 6) AS").replace("l_tax * 2 + l_discount AS", "round(l_tax * 2 + l_discount, 6) AS"))
def ordered_fields(spark, d):
    """Computed fields given in an order that their references do not have."""
    r, n = E.Ref, E.Numeric
    fields = [(n(r("b"), "*", r("tax")), NewField("c")), (n(r("a"), "+", r("discount")), NewField("b")), (n(r("tax"), "*", E.Constant(2, "decimal")), NewField("a"))]
    return R.FilteredReport(lines(d), (R.SelectFields(tuple(R.ordered_fields(fields))),)).run(spark).result()


@query("SELECT ts, value * 2 AS value FROM events WHERE event_type = 'error' AND value > 5")
def filter_pushed_to_source(spark, d):
    """A source that takes a condition in as a filter of its own scan; the filters behind it stay."""

    class Taking(S.TableSeries):
        def try_filter(self, one):
            return replace(self, where=f"({self.where}) AND value > 5") if isinstance(one, S.ConditionFilter) else None

    base = of_type(d, "error")
    source = Taking(**{f.name: getattr(base, f.name) for f in fields(base)})
    greater = S.ConditionFilter(E.Condition("greater_than", E.Ref(), E.Constant(5, "decimal")))
    twice = S.FieldValueFilter(E.Numeric(E.Ref(), "*", E.Constant(2, "decimal")), NewField("twice"))
    return S.FilteredSeries(source, (greater, twice)).run(spark).result()


@query("SELECT * FROM (VALUES ('p50'), ('p75'), ('p90'), ('p95'), ('p99'), ('p999')) t(name), (VALUES (true)) u(near)")
def approximate_percentiles(spark, d):
    """Whether the share of rows below each approximate percentile is within one in a hundred of what it says."""
    from .functions.reductions import PERCENTILES

    made = tuple(A.AggregatedField(p, NewField(p), approx=True) for p in PERCENTILES)
    found = A.FromSeries(events(d), made).run(spark).result()
    rows = table(spark, d, "events").crossJoin(found)  # one row
    aggs = [(F.abs(F.avg(F.when(F.col("value") <= F.col(p), 1.0).otherwise(0.0)) - share) <= 0.01).alias(p) for p, share in PERCENTILES.items()]
    return rows.agg(*aggs).select(F.explode(F.create_map(*[x for p in PERCENTILES for x in (F.lit(p), F.col(p))])).alias("name", "near"))


@query(f"""SELECT ts, round(avg(v), 6) AS value FROM ({_UNION}) WHERE hour(ts) >= 9 AND hour(ts) < 17 AND isodow(ts) BETWEEN 1 AND 5 GROUP BY ts HAVING count(*) = 3""")
def json_reduction_schedule(spark, d):
    """A reduction across three sources of a JSON query, aligned by hour, in business hours."""
    aligner = {"type": "aligner", "alignerPeriod": {"type": "calendar", "alignmentPeriodType": "hour", "zoneId": "UTC"}, "bucketReduction": "sum"}
    slot = {"fromHourOfDay": 9, "fromMinuteOfHour": 0, "toHourOfDay": 17, "toMinuteOfHour": 0}
    command = {
        "from": "2000-01-01T00:00:00+00:00", "to": "2100-01-01T00:00:00+00:00",
        "datasource": {"type": "filtered", "datasource": {"type": "reduction", "reductionType": "avg", "aligner": aligner, "fieldMeta": {"uri": "mean"},
            "multiDatasource": {"type": "list", "datasources": [{"type": "events", "eventType": k} for k in TRIO]}},
            "filters": [{"type": "schedule", "schedule": {"conditions": [{"timeSlots": [slot], "daysOfWeek": [1, 2, 3, 4, 5]}]}}]},
    }
    return execute_query(spark, command, _plugins(d)).result()


@query(f"WITH {COUNTER.format(mod='')} SELECT ts, round((CASE WHEN total < was THEN total ELSE total - was END)::DOUBLE / ((epoch_us(ts) - epoch_us(before)) / 1e6) * 60, 6) AS value FROM l WHERE was IS NOT NULL")
def json_rate(spark, d):
    plugins = Plugins()
    plugins.register("datasource", "counter", lambda parser, node: counter(d))
    command = {"from": "2000-01-01T00:00:00+00:00", "to": "2100-01-01T00:00:00+00:00", "datasource": {"type": "filtered", "datasource": {"type": "counter"}, "filters": [{"type": "rate", "overrideUnit": "per minute", "perSeconds": 60, "nonNegative": True, "emitOnReset": True, "overNoTime": "infinite"}]}}
    return execute_query(spark, command, plugins).result()


@query("SELECT ts, round(value * 2, 6) AS twice, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS band, round(value * 3, 6) AS total, hour(ts)::BIGINT AS hour FROM events WHERE value > 5")
def json_report_fields(spark, d):
    """A report of a JSON query: computed fields of several kinds, a condition and a projection."""
    plugins = _plugins(d)
    ref, const = (lambda u: {"type": "ref", "urn": u}), (lambda v, k="decimal": {"type": "constant", "dataType": k, "required": True, "fieldValue": v})
    above = lambda v: {"type": "condition", "operatorType": "greater_than", "operand1": ref("value"), "operand2": const(v)}
    append = lambda urn, value: {"type": "appendField", "fieldValue": value, "fieldMeta": {"uri": urn}}
    plugins.register("report", "table", lambda parser, node: R.FromDatasource(events(d)))
    report = {"type": "filtered", "reportDatasource": {"type": "table"}, "filters": [
        {"type": "condition", "booleanField": above(5)},
        append("twice", {"type": "numericExpression", "op1": ref("value"), "op": "*", "op2": const(2)}),
        append("band", {"type": "selector", "selectorBooleanField": above(20), "trueField": const("high", "string"), "falseField": const("low", "string")}),
        append("total", {"type": "reduce", "reductionType": "sum", "fieldUrns": ["value", "twice"]}),
        append("hour", {"type": "timestampExtract", "source": {"type": "rowTimestamp"}, "component": "hour", "zoneId": "UTC"}),
        {"type": "projection", "fieldUrns": ["twice", "band", "total", "hour"]},
    ]}
    from .plans.parse import Parser

    return Parser(plugins).report(report).run(spark).result()


@query("""SELECT ts + INTERVAL '1 hour' AS ts, round(abs(0 - value) * 2 + hour(ts + INTERVAL '1 hour'), 6) AS value FROM events
WHERE event_type = 'error' AND value > 5 AND (value < 50 OR value = 60) AND hour(ts + INTERVAL '1 hour') NOT BETWEEN 2 AND 3""")
def json_series_filters(spark, d):
    """Time shift, metadata, logic, schedule exceptions and expressions of a JSON query, in one chain."""
    ref, const = {"type": "ref"}, (lambda v: {"type": "constant", "dataType": "decimal", "required": True, "fieldValue": v})
    compare = lambda op, v: {"type": "condition", "operatorType": op, "operand1": ref, "operand2": const(v)}
    logic = lambda op, a, b: {"type": "logicalExpression", "logicalOperatorType": op, "operand1": a, "operand2": b}
    number = lambda a, op, b: {"type": "numericExpression", "op1": a, "op": op, "op2": b}
    hour = {"type": "cast", "targetType": "decimal", "source": {"type": "timestampExtract", "source": {"type": "rowTimestamp"}, "component": "hour", "zoneId": "UTC"}}
    positive = {"type": "unaryNumericOperator", "op": "abs", "operand": number(const(0), "-", ref)}
    value = number(number({"type": "nvl", "source": {"type": "nil", "dataType": "decimal"}, "altField": positive}, "*", const(2)), "+", hour)
    slot = lambda a, b: {"fromHourOfDay": a, "fromMinuteOfHour": 0, "toHourOfDay": b, "toMinuteOfHour": 0}
    command = {
        "from": "2000-01-01T00:00:00+00:00", "to": "2100-01-01T00:00:00+00:00",
        "datasource": {"type": "filtered", "datasource": {"type": "events", "eventType": "error"}, "filters": [
            {"type": "timeShift", "offsetSeconds": 3600},
            {"type": "overrideFieldMetadata", "updatedUrn": "errors", "updatedUnit": "times"},
            {"type": "condition", "booleanField": logic("and", compare("greater_than", 5), logic("or", compare("less_than", 50), compare("equals", 60)))},
            {"type": "schedule", "schedule": {"conditions": [{"timeSlots": [slot(4, 2)]}], "excludeConditions": [{"timeSlots": [slot(2, 4)]}]}},
            {"type": "fieldValue", "fieldMeta": {"uri": "made"}, "fieldValue": value},
        ]},
    }
    return execute_query(spark, command, _plugins(d)).result()


@query(f"SELECT ts, round(purchase + coalesce(error, -1), 6) AS value FROM {_sums('purchase')} LEFT JOIN {_sums('error')} USING (ts)")
def json_report_join(spark, d):
    """Aligned series joined to a report, a computed field in another's place, others dropped, and one taken as a series."""
    hourly_ = lambda k: {"type": "filtered", "datasource": {"type": "events", "eventType": k}, "filters": [{"type": "aligner", "alignerPeriod": {"type": "custom", "zoneId": "UTC", "durationInMillis": 3_600_000}, "bucketReduction": "sum"}]}
    ref = lambda u: {"type": "ref", "urn": u}
    join = {"type": "join", "joinType": "left", "multiDatasource": {"type": "list", "datasources": [{"type": "fromDatasource", "datasource": hourly_(k)} for k in ("purchase", "error", "view")]}}
    known = {"type": "nvl", "source": ref("error"), "altField": {"type": "constant", "dataType": "decimal", "required": True, "fieldValue": -1}}
    report = {"type": "filtered", "reportDatasource": join, "filters": [
        {"type": "dropFields", "fieldUrns": ["view"]},
        {"type": "appendField", "fieldMeta": {"uri": "both"}, "fieldValue": {"type": "numericExpression", "op1": ref("purchase"), "op": "+", "op2": known}},
        {"type": "overrideFieldMetadata", "fieldUrn": "both", "updatedUnit": "eur"},
        {"type": "singleField", "fieldMeta": {"uri": "one"}, "fieldValue": ref("both")},
    ]}
    command = {"from": "2000-01-01T00:00:00+00:00", "to": "2100-01-01T00:00:00+00:00", "datasource": {"type": "fromReport", "reportDatasource": report, "fieldUrn": "one"}}
    return execute_query(spark, command, _plugins(d)).result()


@query("""SELECT round(max(value) - avg(value), 6) AS above, NULL::TIMESTAMP AS above__ts, round(-min(value), 6) AS depth, NULL::TIMESTAMP AS depth__ts FROM events WHERE event_type = 'error'""")
def json_aggregation_tree(spark, d):
    """Expressions of a composite of two aggregations."""
    ref = lambda u: {"type": "ref", "urn": u}
    one = lambda r, u: {"reductionType": r, "fieldMeta": {"uri": u}}
    source = {"type": "events", "eventType": "error"}
    parts = [
        {"type": "fromDatasource", "datasource": source, "fields": [one("max", "top"), one("avg", "mean")]},
        {"type": "fromReport", "reportDatasource": {"type": "fromDatasource", "datasource": source}, "fields": [{**one("min", "low"), "sourceFieldUrn": "error"}]},
    ]
    fields = [
        {"fieldMeta": {"uri": "above"}, "value": {"type": "numericExpression", "op1": ref("top"), "op": "-", "op2": ref("mean")}},
        {"fieldMeta": {"uri": "depth"}, "value": {"type": "unaryNumericOperator", "op": "negate", "operand": ref("low")}},
    ]
    command = {"from": "2000-01-01T00:00:00+00:00", "to": "2100-01-01T00:00:00+00:00", "aggregation": {"type": "expression", "source": {"type": "composite", "aggregations": parts}, "fields": fields}}
    return execute_aggregation(spark, command, _plugins(d)).result()


INVALID = {
    "unknown node": {"type": "nothing"},
    "no type": {"fieldMeta": {}},
    "bad period": {"type": "filtered", "datasource": {"type": "events", "eventType": "error"}, "filters": [{"type": "aligner", "alignerPeriod": {"type": "custom", "durationInMillis": 0, "zoneId": "UTC"}}]},
    "bad zone": {"type": "filtered", "datasource": {"type": "events", "eventType": "error"}, "filters": [{"type": "aligner", "alignerPeriod": {"type": "calendar", "alignmentPeriodType": "day", "zoneId": "Nowhere/At"}}]},
    "delta of a gauge": {"type": "filtered", "datasource": {"type": "events", "eventType": "error"}, "filters": [{"type": "delta"}]},
    "no shift": {"type": "filtered", "datasource": {"type": "events", "eventType": "error"}, "filters": [{"type": "timeShift", "offsetSeconds": 0}]},
    "unknown reduction": {"type": "reduction", "reductionType": "middle", "multiDatasource": {"type": "list", "datasources": [{"type": "events", "eventType": "error"}]}},
    "nothing to reduce": {"type": "reduction", "reductionType": "sum", "multiDatasource": {"type": "list", "datasources": []}},
    "required null": {"type": "static", "fieldMeta": {"uri": "x", "dataType": "integer", "required": True}, "data": [{"timestamp": "2024-01-01T00:00:00+00:00", "value": None}]},
    "bad type": {"type": "static", "fieldMeta": {"uri": "x", "dataType": "number"}, "data": []},
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in INVALID) + ") t(query), (VALUES ('QueryError')) u(raised)")
def invalid_queries(spark, d):
    """What wrong queries raise before any Spark job."""
    raised = []
    for name, node in INVALID.items():
        try:
            execute_query(spark, {"from": "2024-01-01T00:00:00+00:00", "to": "2024-02-01T00:00:00+00:00", "datasource": node}, _plugins(d))
            raised.append((name, "nothing"))
        except Exception as e:
            raised.append((name, type(e).__name__))
    return spark.createDataFrame(raised, "query string, raised string")


# ---------------------------------------------------------------- more streams


@query("SELECT k::BIGINT AS k, (k * k)::BIGINT AS square, 'm' || k AS name FROM range(500) r(k)")
def stream_json_messages(spark, d):
    """JSON messages of an endless source, as a websocket sends them, up to where it is now."""
    import json

    from .streaming import series as X

    def messages(offset):
        return ((k, json.dumps({"k": k, "square": k * k, "name": f"m{k}"})) for k in range(offset, 500))

    place = f"{shared_root(spark)}/tidewheel-messages-{uuid.uuid4().hex}"
    stream = X.json_messages(X.message_stream(spark, messages, 500), "k long, square long, name string")
    X.run_to_files(stream, f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out")
