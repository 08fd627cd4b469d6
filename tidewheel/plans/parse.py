"""Queries in JSON: a ``type`` names each node; unknown ones go to registered plugins."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from ..functions import expressions as E
from ..functions.periods import FixedPeriod, Period, calendar_period
from ..meta import FieldMeta, NewField, QueryError, duration_us
from ..operators import aggregation as A
from ..operators import report as R
from ..operators import series as S
from ..operators.schedule import Schedule, ScheduleCondition, TimeSlot, YearPeriod

Json = Mapping[str, Any]
ROLES = ("datasource", "multi_datasource", "filter", "value", "report", "multi_report", "report_filter", "report_value")


@dataclass
class Plugins:
    """Parsers of further node types: {role: {type: function(parser, json)}}. Aggregations have none."""

    parsers: dict[str, dict[str, Callable]] = field(default_factory=dict)

    def register(self, role: str, name: str, parser: Callable) -> None:
        if role not in ROLES:
            raise QueryError(f"no plugins for {role!r}")
        self.parsers.setdefault(role, {})[name] = parser


def _type(node: Any, what: str) -> str:
    if not isinstance(node, Mapping) or not isinstance(node.get("type"), str):
        raise QueryError(f"a {what} needs a type")
    return node["type"]


def _need(node: Json, name: str) -> Any:
    if node.get(name) is None:
        raise QueryError(f"{node.get('type', 'a node')} needs {name}")
    return node[name]


def parse_time(text: Any) -> datetime:
    if isinstance(text, datetime):
        return text
    try:
        return datetime.fromisoformat(str(text))
    except ValueError as e:
        raise QueryError(f"no time: {text!r}") from e


def field_meta(node: Json) -> FieldMeta:
    period = node.get("samplePeriod")
    return FieldMeta(_need(node, "dataType"), bool(node.get("required", False)), node.get("unit") or "", node.get("metricKind") or None, duration_us(period) if period else None, dict(node.get("customMetadata") or {}), _need(node, "uri"))


def new_field(node: Json) -> NewField:
    period, custom = node.get("overrideSamplePeriod"), node.get("customMetadata")
    return NewField(_need(node, "uri"), node.get("overrideUnit") or None, node.get("overrideMetricKind") or None, duration_us(period) if period else None, dict(custom) if custom is not None else None)


def alignment_period(node: Json) -> Period:
    kind = _type(node, "period")
    if kind == "calendar":
        return calendar_period(_need(node, "alignmentPeriodType"), node.get("zoneId"))
    if kind == "custom":
        return FixedPeriod(_need(node, "durationInMillis") * 1000, (node.get("offsetInMillis") or 0) * 1000, node.get("zoneId") or "UTC")
    raise QueryError(f"unknown period {kind!r}")


def schedule(node: Json) -> Schedule:
    def slot(n: Json) -> TimeSlot:
        return TimeSlot(n["fromHourOfDay"], n["fromMinuteOfHour"], n["toHourOfDay"], n["toMinuteOfHour"])

    def span(n: Json) -> YearPeriod:
        return YearPeriod(n["startMonth"], n["startDayOfMonth"], n["endMonth"], n["endDayOfMonth"])

    def condition(n: Json) -> ScheduleCondition:
        many = lambda name, make=lambda x: x: tuple(make(x) for x in n.get(name) or ())
        return ScheduleCondition(many("timeSlots", slot), many("daysOfWeek"), many("periods", span), many("dates"), many("excludePeriods", span), many("excludeDates"))

    at = lambda name: parse_time(node[name]) if node.get(name) else None
    return Schedule(tuple(map(condition, _need(node, "conditions"))), tuple(map(condition, node.get("excludeConditions") or ())), at("startTime"), at("endTime"), node.get("customTimezone"))


def counter(node: Json) -> S.Counter:
    gap = node.get("maxGapDuration")
    return S.Counter(bool(node.get("nonNegative")), node.get("maxCounterValue"), bool(node.get("emitOnReset")), duration_us(gap) if gap else None)


class Parser:
    def __init__(self, plugins: Plugins | None = None):
        self.plugins = plugins or Plugins()

    def _own(self, role: str, node: Json, known: Mapping[str, Callable]) -> Any:
        kind = _type(node, role)
        make = known.get(kind)
        if make is not None:
            return make(node)
        make = self.plugins.parsers.get(role, {}).get(kind)
        if make is None:
            raise QueryError(f"unknown {role} {kind!r}")
        return make(self, node)

    # series

    def datasource(self, node: Json) -> S.Datasource:
        return self._own("datasource", node, {"static": self._static, "filtered": self._filtered, "reduction": self._reduction, "fromReport": self._from_report})

    def _static(self, n: Json) -> S.StaticSeries:
        return S.StaticSeries(field_meta(_need(n, "fieldMeta")), [(parse_time(r["timestamp"]), r.get("value")) for r in n.get("data") or ()])

    def _filtered(self, n: Json) -> S.FilteredSeries:
        return S.FilteredSeries(self.datasource(_need(n, "datasource")), tuple(map(self.filter, n.get("filters") or ())))

    def _reduction(self, n: Json) -> S.ReductionSeries:
        aligner, empty = n.get("aligner"), n.get("emptyDatasourceValue")
        value = self.value(empty) if empty else None
        if value is not None and not isinstance(value, E.Constant):
            raise QueryError("a fallback value must be a constant")
        meta = n.get("fieldMeta")
        return S.ReductionSeries(_need(n, "reductionType"), self.multi_datasource(_need(n, "multiDatasource")), self._aligner(aligner) if aligner else None, new_field(meta) if meta else None, value, bool(n.get("includePartial")))

    def _from_report(self, n: Json) -> R.ToDatasource:
        return R.ToDatasource(self.report(_need(n, "reportDatasource")), _need(n, "fieldUrn"))

    def multi_datasource(self, node: Json) -> S.MultiDatasource:
        return self._own("multi_datasource", node, {
            "list": lambda n: S.ListSeries(tuple(map(self.datasource, n.get("datasources") or ()))),
            "filtered": lambda n: S.FilteredMany(self.multi_datasource(_need(n, "multiDatasource")), tuple(map(self.filter, n.get("filters") or ()))),
        })

    def _aligner(self, n: Json) -> S.Aligner:
        return S.Aligner(alignment_period(_need(n, "alignerPeriod")), S.check_fill(n.get("fillMode") or None), n.get("bucketReduction") or None)

    def filter(self, node: Json) -> S.SeriesFilter:
        return self._own("filter", node, {
            "aligner": self._aligner,
            "condition": lambda n: S.ConditionFilter(self.value(_need(n, "booleanField"))),
            "fieldValue": lambda n: S.FieldValueFilter(self.value(_need(n, "fieldValue")), new_field(_need(n, "fieldMeta"))),
            "overrideFieldMetadata": lambda n: S.OverrideMeta(**self._overrides(n)),
            "delta": lambda n: S.DeltaFilter(counter(n)),
            "rate": lambda n: S.RateFilter(n.get("overrideUnit") or "", n.get("perSeconds") or 1, counter(n), n.get("overNoTime") or "error"),
            "schedule": lambda n: S.ScheduleFilter(schedule(_need(n, "schedule"))),
            "timeShift": lambda n: S.TimeShift(_need(n, "offsetSeconds")),
        })

    @staticmethod
    def _overrides(n: Json) -> dict[str, Any]:
        period = n.get("updatedSamplePeriod")
        return {"urn": n.get("updatedUrn") or None, "unit": n.get("updatedUnit") or None, "kind": n.get("updatedMetricKind") or None, "sample_period": duration_us(period) if period else None, "custom": n.get("updatedCustomMeta")}

    # expressions

    def value(self, node: Json) -> E.Expr:
        return self._expression("value", node, self.value, lambda n: E.Ref())

    def report_value(self, node: Json) -> E.Expr:
        urns = lambda n: tuple(n["fieldUrns"]) if n.get("fieldUrns") else None
        return self._expression("report_value", node, self.report_value, lambda n: E.Ref(_need(n, "urn")), {"reduce": lambda n: E.ReduceFields(_need(n, "reductionType"), urns(n))})

    def _expression(self, role: str, node: Json, again: Callable, ref: Callable, more: Mapping[str, Callable] | None = None) -> E.Expr:
        two = lambda n, a, b: (again(_need(n, a)), again(_need(n, b)))
        return self._own(role, node, {
            "constant": lambda n: E.Constant(n.get("fieldValue"), _need(n, "dataType"), bool(n.get("required", True)), n.get("unit") or ""),
            "nil": lambda n: E.Nil(_need(n, "dataType"), n.get("unit") or ""),
            "ref": ref,
            "rowTimestamp": lambda n: E.RowTimestamp(),
            "timestampExtract": lambda n: E.TimestampExtract(again(_need(n, "source")), _need(n, "component"), n.get("zoneId")),
            "cast": lambda n: E.Cast(again(_need(n, "source")), _need(n, "targetType")),
            "numericExpression": lambda n: E.Numeric(again(_need(n, "op1")), _need(n, "op"), again(_need(n, "op2"))),
            "unaryNumericOperator": lambda n: E.Unary(again(_need(n, "operand")), _need(n, "op")),
            "condition": lambda n: E.Condition(_need(n, "operatorType"), *two(n, "operand1", "operand2")),
            "logicalExpression": lambda n: E.Logical(_need(n, "logicalOperatorType"), *two(n, "operand1", "operand2")),
            "selector": lambda n: E.Selector(again(_need(n, "selectorBooleanField")), *two(n, "trueField", "falseField")),
            "nvl": lambda n: E.Nvl(*two(n, "source", "altField")),
            **(more or {}),
        })

    # reports

    def report(self, node: Json) -> R.ReportSource:
        return self._own("report", node, {
            "static": lambda n: R.StaticReport(tuple(map(field_meta, n.get("fieldsMeta") or ())), [(parse_time(r["timestamp"]), r["values"]) for r in n.get("data") or ()]),
            "join": lambda n: R.JoinReports(self.multi_report(_need(n, "multiDatasource")), _need(n, "joinType")),
            "fromDatasource": lambda n: R.FromDatasource(self.datasource(_need(n, "datasource"))),
            "filtered": lambda n: R.FilteredReport(self.report(_need(n, "reportDatasource")), self.report_filters(n.get("filters") or ())),
        })

    def multi_report(self, node: Json) -> R.MultiReport:
        return self._own("multi_report", node, {
            "list": lambda n: R.ListReports(tuple(map(self.report, n.get("datasources") or ()))),
            "fromMultiDatasource": lambda n: R.FromMultiDatasource(self.multi_datasource(_need(n, "multiDatasource"))),
            "filtered": lambda n: R.FilteredReports(self.multi_report(_need(n, "reportMultiDatasource")), self.report_filters(n.get("filters") or ())),
        })

    def report_filters(self, nodes) -> tuple[R.ReportFilter, ...]:
        return tuple(map(self.report_filter, nodes))

    def report_filter(self, node: Json) -> R.ReportFilter:
        def aligner(n: Json) -> R.ReportAligner:
            own = {urn: R.FieldAlignment(a.get("reduction") or None, a.get("fillMode") or None) for urn, a in (n.get("fieldAlignments") or {}).items()}
            return R.ReportAligner(alignment_period(_need(n, "alignerPeriod")), S.check_fill(n.get("fillMode") or None), own)

        return self._own("report_filter", node, {
            "aligner": aligner,
            "condition": lambda n: R.ReportCondition(self.report_value(_need(n, "booleanField"))),
            "appendField": lambda n: R.AppendField(self.report_value(_need(n, "fieldValue")), new_field(_need(n, "fieldMeta"))),
            "dropFields": lambda n: R.DropFields(tuple(_need(n, "fieldUrns"))),
            "singleField": lambda n: R.SingleField(self.report_value(_need(n, "fieldValue")), new_field(_need(n, "fieldMeta"))),
            "projection": lambda n: R.projection(_need(n, "fieldUrns")),
            "overrideFieldMetadata": lambda n: R.OverrideFieldMeta(_need(n, "fieldUrn"), **self._overrides(n)),
            "schedule": lambda n: R.ReportSchedule(schedule(_need(n, "schedule"))),
            "timeShift": lambda n: R.ReportTimeShift(S.TimeShift(_need(n, "offsetSeconds")).seconds),
        })

    # aggregations

    def aggregation(self, node: Json) -> A.Aggregation:
        kind = _type(node, "aggregation")
        if kind == "fromDatasource":
            return A.FromSeries(self.datasource(_need(node, "datasource")), tuple(map(self._aggregated, _need(node, "fields"))))
        if kind == "fromReport":
            return A.FromReport(self.report(_need(node, "reportDatasource")), tuple(map(self._aggregated, _need(node, "fields"))))
        if kind == "composite":
            return A.Composite(tuple(map(self.aggregation, _need(node, "aggregations"))))
        if kind == "expression":
            return A.FromExpressions(self.aggregation(_need(node, "source")), tuple((self.aggregation_value(_need(f, "value")), new_field(_need(f, "fieldMeta"))) for f in _need(node, "fields")))
        raise QueryError(f"unknown aggregation {kind!r}")

    def _aggregated(self, f: Json) -> A.AggregatedField:
        empty = self.value(f["emptyValue"]) if f.get("emptyValue") else None
        if empty is not None and not isinstance(empty, E.Constant):
            raise QueryError("a fallback value must be a constant")
        meta = f.get("fieldMeta")
        return A.AggregatedField(_need(f, "reductionType"), new_field(meta) if meta else None, empty, f.get("sourceFieldUrn"), f.get("compareFieldUrn"), bool(f.get("approximate")))

    def aggregation_value(self, node: Json) -> E.Expr:
        kind, again = _type(node, "value"), self.aggregation_value
        if kind == "ref":
            return E.Ref(_need(node, "urn"))
        if kind == "constant":
            return E.Constant(node.get("fieldValue"), _need(node, "dataType"))
        if kind == "numericExpression":
            return E.Numeric(again(_need(node, "op1")), _need(node, "op"), again(_need(node, "op2")))
        if kind == "unaryNumericOperator":
            return E.Unary(again(_need(node, "operand")), _need(node, "op"))
        if kind == "cast":
            return E.Cast(again(_need(node, "source")), _need(node, "targetType"))
        raise QueryError(f"unknown value {kind!r}")


def execute_query(spark: SparkSession, command: Json, plugins: Plugins | None = None) -> S.Series:
    """The command ``{datasource, from, to}``: a series, lazily."""
    source = Parser(plugins).datasource(_need(command, "datasource"))
    return source.run(spark, parse_time(_need(command, "from")), parse_time(_need(command, "to")))


def execute_aggregation(spark: SparkSession, command: Json, plugins: Plugins | None = None) -> A.Scalars:
    """The command ``{aggregation, from, to}``: scalars, lazily."""
    found = Parser(plugins).aggregation(_need(command, "aggregation"))
    return found.run(spark, parse_time(_need(command, "from")), parse_time(_need(command, "to")))


def series_json(series: S.Series) -> dict[str, Any]:
    """A series as the JSON result {meta, data}; for results that fit the driver."""
    rows = series.df.orderBy("ts", "seq").select("ts", "value").toLocalIterator()
    return {"meta": series.meta.as_json(), "data": [{"timestamp": r["ts"].isoformat(), "value": r["value"]} for r in rows]}


def scalars_json(found: A.Scalars) -> dict[str, Any]:
    row, out = found.df.first(), []
    for k, m in enumerate(found.metas):
        one = {"meta": m.as_json(), "value": row[f"v{k}"]}
        out.append(one | ({"timestamp": row[f"t{k}"].isoformat()} if row[f"t{k}"] else {}))
    return {"fields": out}
