"""Several fields over time: sources, joins and filters of the report layer.

A report is a DataFrame of (ts, seq, f0, f1, ...) and its fields' metadata; names become columns only
in ``result``, so a name may hold any character.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Expr, Ref, Scope, required_boolean
from ..functions.periods import Period
from ..functions.reductions import check_reduction, check_source, result_type
from ..meta import FieldMeta, NewField, QueryError, distinct_urns, spark_type
from .schedule import Schedule
from .series import Datasource, MultiDatasource, Series, TimeShift, aligned_columns, check_fill, filled, in_range, numbered


@dataclass(frozen=True)
class Report:
    metas: list[FieldMeta]
    df: DataFrame
    unique: bool = False

    @property
    def names(self) -> list[str]:
        return [f"f{k}" for k in range(len(self.metas))]

    def scope(self) -> Scope:
        return Scope(F.col("ts"), {m.urn: (m, F.col(c)) for m, c in zip(self.metas, self.names, strict=True)})

    def index(self, urn: str) -> int:
        for k, m in enumerate(self.metas):
            if m.urn == urn:
                return k
        raise QueryError(f"unknown field {urn!r}")

    def with_fields(self, metas: list[FieldMeta], columns: list) -> Report:
        distinct_urns(metas)
        return Report(metas, self.df.select("ts", "seq", *[c.alias(f"f{k}") for k, c in enumerate(columns)]), self.unique)

    def but(self, df: DataFrame) -> Report:
        return Report(self.metas, df, self.unique)

    def result(self) -> DataFrame:
        """(ts, a column a field by its name, its metadata attached)."""
        return self.df.select("ts", *[F.col(c).alias(m.urn, metadata=m.as_json()) for c, m in zip(self.names, self.metas, strict=True)])


class ReportSource:
    def run(self, spark: SparkSession, start: datetime | None = None, end: datetime | None = None) -> Report:
        raise NotImplementedError

    def try_filter(self, one: ReportFilter) -> ReportSource | None:
        return None


def _checked(metas: Sequence[FieldMeta]) -> list[FieldMeta]:
    if not metas:
        raise QueryError("a report needs a field")
    return distinct_urns(list(metas))


@dataclass(frozen=True)
class StaticReport(ReportSource):
    """Rows given in the query: (timestamp, values)."""

    metas: tuple[FieldMeta, ...]
    rows: Sequence[tuple[datetime, Sequence[Any]]] = field(hash=False)

    def run(self, spark, start=None, end=None) -> Report:
        metas, rows = _checked(self.metas), []
        for k, (ts, values) in enumerate(self.rows):
            if len(values) != len(metas):
                raise QueryError("a row has another number of values than the report has fields")
            for v, m in zip(values, metas, strict=True):
                if v is None and m.required:
                    raise QueryError(f"{m.urn}: a required value is null")
            rows.append((ts, k, *[float(v) if m.data_type == "decimal" and v is not None else v for v, m in zip(values, metas, strict=True)]))
        schema = ", ".join(["ts timestamp", "seq long", *[f"f{k} {spark_type(m.data_type)}" for k, m in enumerate(metas)]])
        return Report(metas, in_range(spark.createDataFrame(rows, schema), start, end))


@dataclass(frozen=True)
class TableReport(ReportSource):
    """Columns of a table, as (metadata, column or SQL expression)."""

    fields: tuple[tuple[FieldMeta, str], ...]
    make: Callable[[SparkSession], DataFrame] = field(hash=False)
    ts: str = "ts"
    seq: str | None = None
    unique: bool = False

    def run(self, spark, start=None, end=None) -> Report:
        metas = _checked([m for m, _ in self.fields])
        seq = F.expr(self.seq).cast("long") if self.seq else F.lit(0).cast("long")
        cols = [F.expr(c).cast(spark_type(m.data_type)).alias(f"f{k}") for k, (m, c) in enumerate(self.fields)]
        df = self.make(spark).select(F.col(self.ts).cast("timestamp").alias("ts"), seq.alias("seq"), *cols)
        return Report(metas, in_range(df, start, end), self.unique)


# Types of a dataclass's fields as types of a query.
PYTHON_TYPES = {bool: "boolean", int: "integer", float: "decimal", str: "string"}


def struct_report(kind: type, rows: Sequence[Any]) -> StaticReport:
    """A report of dataclass instances: one field is the time, the others are optional fields named Class:field."""
    hints = get_type_hints(kind)
    fields = [f.name for f in dataclasses.fields(kind)]
    times = [n for n in fields if hints[n] is datetime]
    if len(times) != 1:
        raise QueryError(f"{kind.__name__} must have exactly one time field, not {len(times)}")
    others = [n for n in fields if n not in times]
    for n in others:
        if hints[n] not in PYTHON_TYPES:
            raise QueryError(f"{kind.__name__}.{n}: unsupported type {hints[n]!r}")
    metas = tuple(FieldMeta(PYTHON_TYPES[hints[n]], False, urn=f"{kind.__name__}:{n}") for n in others)
    return StaticReport(metas, [(getattr(r, times[0]), [getattr(r, n) for n in others]) for r in rows])


@dataclass(frozen=True)
class FromDatasource(ReportSource):
    source: Datasource

    def run(self, spark, start=None, end=None) -> Report:
        s = self.source.run(spark, start, end)
        return Report([s.meta], s.df.select("ts", "seq", F.col("value").alias("f0")), s.unique)


@dataclass(frozen=True)
class ToDatasource(Datasource):
    """One field of a report as a series."""

    source: ReportSource
    urn: str

    def run(self, spark, start=None, end=None) -> Series:
        r = self.source.run(spark, start, end)
        k = r.index(self.urn)
        return Series(r.metas[k], r.df.select("ts", F.col(f"f{k}").alias("value"), "seq"), r.unique)


class MultiReport:
    def members(self) -> list[ReportSource]:
        raise NotImplementedError


@dataclass(frozen=True)
class ListReports(MultiReport):
    sources: tuple[ReportSource, ...]

    def members(self) -> list[ReportSource]:
        return list(self.sources)


@dataclass(frozen=True)
class FromMultiDatasource(MultiReport):
    source: MultiDatasource

    def members(self) -> list[ReportSource]:
        return [FromDatasource(m) for m in self.source.members()]


@dataclass(frozen=True)
class FilteredReports(MultiReport):
    source: MultiReport
    filters: tuple[ReportFilter, ...]

    def members(self) -> list[ReportSource]:
        return [FilteredReport(m, self.filters) for m in self.source.members()]


@dataclass(frozen=True)
class JoinReports(ReportSource):
    """Reports side by side by time.

    Rows of equal time join by position in an inner or full join; in a left join each left row takes
    the first right row. Inner and full joins of any number of reports are one aggregation by time.
    """

    source: MultiReport
    kind: str = "inner"

    def run(self, spark, start=None, end=None) -> Report:
        if self.kind not in ("inner", "left", "full"):
            raise QueryError(f"unknown join {self.kind!r}")
        parts = [m.run(spark, start, end) for m in self.source.members()]
        if not parts:
            raise QueryError("no reports to join")
        optional = [self.kind == "full" or (self.kind == "left" and k > 0) for k in range(len(parts))]
        metas = distinct_urns([replace(m, required=m.required and not o) for p, o in zip(parts, optional, strict=True) for m in p.metas])
        if len(parts) == 1:
            return Report(metas, parts[0].df, parts[0].unique)
        df = self._left(parts) if self.kind == "left" else self._positional(parts)
        return Report(metas, df, all(p.unique for p in parts))

    def _left(self, parts: list[Report]) -> DataFrame:
        at, out = len(parts[0].names), parts[0].df
        for p in parts[1:]:
            right = p.df
            if not p.unique:
                right = right.groupBy("ts").agg(F.min_by(F.struct(*p.names), "seq").alias("r")).select("ts", "r.*")
            out = out.join(right.select("ts", *[F.col(c).alias(f"f{at + k}") for k, c in enumerate(p.names)]), "ts", "left")
            at += len(p.names)
        return out.select("ts", "seq", *[f"f{k}" for k in range(at)])

    def _positional(self, parts: list[Report]) -> DataFrame:
        packed = []
        for k, p in enumerate(parts):
            own = F.struct(*p.names).alias(f"s{k}")
            others = [F.lit(None).cast(q.df.select(F.struct(*q.names)).schema[0].dataType).alias(f"s{j}") for j, q in enumerate(parts) if j != k]
            packed.append(numbered(p.df, p.unique).select("ts", "dup", own, *others).select("ts", "dup", *[f"s{j}" for j in range(len(parts))]))
        rows = reduce(DataFrame.unionByName, packed)
        whole = rows.groupBy("ts", "dup").agg(*[F.first(f"s{k}", ignorenulls=True).alias(f"s{k}") for k in range(len(parts))])
        if self.kind == "inner":
            whole = whole.filter(reduce(lambda a, b: a & b, [F.col(f"s{k}").isNotNull() for k in range(len(parts))]))
        cols = [F.col(f"s{k}")[c] for k, p in enumerate(parts) for c in p.names]
        return whole.select("ts", F.col("dup").cast("long").alias("seq"), *[c.alias(f"f{k}") for k, c in enumerate(cols)])


# ---------------------------------------------------------------- filters


class ReportFilter:
    def apply(self, report: Report) -> Report:
        raise NotImplementedError


@dataclass(frozen=True)
class FilteredReport(ReportSource):
    source: ReportSource
    filters: tuple[ReportFilter, ...]

    def run(self, spark, start=None, end=None) -> Report:
        source, rest = self.source, list(self.filters)
        while rest and (taken := source.try_filter(rest[0])) is not None:
            source = taken
            rest.pop(0)
        found = source.run(spark, start, end)
        for one in rest:
            found = one.apply(found)
        return found


@dataclass(frozen=True)
class ReportCondition(ReportFilter):
    condition: Expr

    def apply(self, report: Report) -> Report:
        return report.but(report.df.filter(required_boolean(self.condition, report.scope(), "a condition filter")))


@dataclass(frozen=True)
class AppendField(ReportFilter):
    value: Expr
    new: NewField

    def apply(self, report: Report) -> Report:
        meta, column = self.value.bind(report.scope())
        return report.with_fields([*report.metas, self.new.of(meta)], [*map(F.col, report.names), column])


@dataclass(frozen=True)
class ReplaceField(ReportFilter):
    urn: str
    value: Expr
    new: NewField

    def apply(self, report: Report) -> Report:
        k = report.index(self.urn)
        meta, column = self.value.bind(report.scope())
        metas, cols = list(report.metas), [*map(F.col, report.names)]
        metas[k], cols[k] = self.new.of(meta), column
        return report.with_fields(metas, cols)


@dataclass(frozen=True)
class DropFields(ReportFilter):
    urns: tuple[str, ...]

    def apply(self, report: Report) -> Report:
        gone = {report.index(u) for u in self.urns}
        left = [k for k in range(len(report.metas)) if k not in gone]
        if not left:
            raise QueryError("all fields would be dropped")
        return report.with_fields([report.metas[k] for k in left], [F.col(f"f{k}") for k in left])


@dataclass(frozen=True)
class SelectFields(ReportFilter):
    """Computed fields in order; each may read the fields made before it as well as the report's."""

    fields: tuple[tuple[Expr, NewField], ...]

    def apply(self, report: Report) -> Report:
        scope, metas, cols = report.scope(), [], []
        for value, new in self.fields:
            meta, column = value.bind(scope)
            metas.append(new.of(meta))
            cols.append(column)
            scope = Scope(scope.ts, scope.fields | {new.urn: (metas[-1], column)})
        return report.with_fields(_checked(metas), cols)


def projection(urns: Sequence[str]) -> SelectFields:
    """Fields of the report by name, metadata unchanged."""
    return SelectFields(tuple((Ref(u), NewField(u)) for u in urns))


@dataclass(frozen=True)
class SingleField(ReportFilter):
    value: Expr
    new: NewField

    def apply(self, report: Report) -> Report:
        return SelectFields(((self.value, self.new),)).apply(report)


@dataclass(frozen=True)
class OverrideFieldMeta(ReportFilter):
    """Metadata of one field; custom metadata is dropped where none is given."""

    target: str
    urn: str | None = None
    unit: str | None = None
    kind: str | None = None
    sample_period: int | None = None
    custom: dict | None = field(default=None, hash=False)

    def apply(self, report: Report) -> Report:
        k = report.index(self.target)
        given = {n: v for n, v in vars(self).items() if n not in ("target", "custom") and v is not None}
        metas = list(report.metas)
        metas[k] = replace(metas[k], custom=self.custom or {}, **given)
        return Report(distinct_urns(metas), report.df, report.unique)


@dataclass(frozen=True)
class ReportTimeShift(ReportFilter):
    seconds: int

    def apply(self, report: Report) -> Report:
        return report.but(report.df.withColumn("ts", TimeShift(self.seconds).shifted(F.col("ts"))))


@dataclass(frozen=True)
class ReportSchedule(ReportFilter):
    schedule: Schedule

    def apply(self, report: Report) -> Report:
        return report.but(report.df.filter(self.schedule.matches(F.col("ts"))))


@dataclass(frozen=True)
class FieldAlignment:
    reduction: str | None = None
    fill: str | None = None


@dataclass(frozen=True)
class ReportAligner(ReportFilter):
    """All fields, which are numbers, to one period; reduction and fill may differ by field."""

    period: Period
    fill: str | None = None
    fields: dict[str, FieldAlignment] = field(default_factory=dict, hash=False)

    def apply(self, report: Report) -> Report:
        check_fill(self.fill)
        for m in report.metas:
            if not m.numeric:
                raise QueryError(f"{m.urn}: only numbers can be aligned in a report, not a {m.data_type}")
        for urn, one in self.fields.items():
            report.index(urn)
            if one.fill and not self.fill:
                raise QueryError(f"{urn}: a field's fill needs the aligner's")
            check_fill(one.fill)
        metas, how, modes = [], {}, {}
        for m, c in zip(report.metas, report.names, strict=True):
            own = self.fields.get(m.urn, FieldAlignment())
            reduction = check_reduction(own.reduction, paired=False) if own.reduction else ("sum" if m.metric_kind == "delta" else None)
            if reduction:
                check_source(reduction, m)
            out = replace(m, data_type=result_type(reduction, m.data_type)) if reduction else m
            metas.append(replace(out, unit="", required=True) if reduction == "count" else out)
            how[c], modes[c] = (m, reduction), (own.fill or self.fill, spark_type(metas[-1].data_type))
        df = aligned_columns(report.df, self.period, how)
        if self.fill:
            df = filled(df, self.period, modes)
        return Report(metas, df.select("ts", F.lit(0).cast("long").alias("seq"), *report.names), True)


def ordered_fields(fields: Sequence[tuple[Expr, NewField]]) -> list[tuple[Expr, NewField]]:
    """Computed fields so that each comes after those it reads; others keep their order. Cycles are errors."""
    import graphlib

    made = {new.urn: (value, new) for value, new in fields}
    graph = graphlib.TopologicalSorter({urn: sorted(value.refs() & (made.keys() - {urn}) | ({urn} & value.refs())) for urn, (value, _) in made.items()})
    try:
        return [made[u] for u in graph.static_order()]
    except graphlib.CycleError as e:
        raise QueryError(f"computed fields read each other: {' -> '.join(map(str, e.args[1]))}") from e
