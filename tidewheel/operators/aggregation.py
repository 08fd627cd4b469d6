"""Scalars of series and reports: many reductions in one pass, and expressions of their results.

A result is a DataFrame of one row with a value v0, v1, ... and a time t0, t1, ... for each field; the
time is null for reductions that have none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Constant, Expr, Scope
from ..functions.reductions import PAIRED, check_reduction, check_source, over_rows, paired, reduced_unit, result_type, time_of
from ..meta import FieldMeta, NewField, QueryError, distinct_urns, spark_type
from .report import Report, ReportSource
from .series import Datasource


@dataclass(frozen=True)
class Scalars:
    metas: list[FieldMeta]
    df: DataFrame

    def result(self) -> DataFrame:
        """Columns by name: the value, and ``<name>__ts``."""
        cols = []
        for k, m in enumerate(self.metas):
            cols += [F.col(f"v{k}").alias(m.urn, metadata=m.as_json()), F.col(f"t{k}").alias(f"{m.urn}__ts")]
        return self.df.select(*cols)


class Aggregation:
    def run(self, spark: SparkSession, start: datetime | None = None, end: datetime | None = None) -> Scalars:
        raise NotImplementedError


@dataclass(frozen=True)
class AggregatedField:
    """One reduction; ``source`` and ``compare`` name fields of a report."""

    reduction: str
    new: NewField | None = None
    empty: Constant | None = None
    source: str | None = None
    compare: str | None = None
    approx: bool = False


def _columns(one: AggregatedField, meta: FieldMeta, value: Column, ts: Column, other: Column | None) -> tuple[Column, Column]:
    order = F.struct("ts", "seq")
    if other is not None:
        found, when = paired(one.reduction, value, other), None
    else:
        found, when = over_rows(one.reduction, value, order, meta.data_type, one.approx), time_of(one.reduction, value, ts, order)
    return found, F.lit(None).cast("timestamp") if when is None else when


def _scalars(df: DataFrame, fields: Sequence[tuple[AggregatedField, FieldMeta, Column, Column | None]]) -> Scalars:
    if not fields:
        raise QueryError("an aggregation needs a field")
    several, metas, aggs, post = len(fields) > 1, [], [], []
    for k, (one, meta, value, other) in enumerate(fields):
        new = one.new or NewField(f"{meta.urn}_{one.reduction}" if several else meta.urn)
        out = FieldMeta(result_type(one.reduction, meta.data_type), meta.required, reduced_unit(one.reduction, meta.unit), "gauge", None, meta.custom, new.urn or meta.urn)
        out = new.of(out)
        metas.append(FieldMeta(out.data_type, out.required, out.unit, out.kind, None, out.custom, out.urn))
        v, t = _columns(one, meta, value, F.col("ts"), other)
        aggs += [v.alias(f"v{k}"), t.alias(f"t{k}")]
        kind = spark_type(out.data_type)
        filled = F.col(f"v{k}")
        if one.empty is not None:
            given, constant = one.empty.bind(Scope(None, {}))
            if given.data_type != out.data_type and not (given.numeric and out.numeric):
                raise QueryError(f"{out.urn}: a fallback of type {given.data_type} for {out.data_type}")
            filled = F.coalesce(filled, constant.cast(kind))
        post += [filled.cast(kind).alias(f"v{k}"), F.col(f"t{k}")]
    distinct_urns(metas)
    return Scalars(metas, df.agg(*aggs).select(*post))


@dataclass(frozen=True)
class FromSeries(Aggregation):
    source: Datasource
    fields: tuple[AggregatedField, ...]

    def run(self, spark, start=None, end=None) -> Scalars:
        s = self.source.run(spark, start, end)
        for one in self.fields:
            check_reduction(one.reduction, paired=False)
            check_source(one.reduction, s.meta)
        return _scalars(s.df, [(one, s.meta, F.col("value"), None) for one in self.fields])


@dataclass(frozen=True)
class FromReport(Aggregation):
    source: ReportSource
    fields: tuple[AggregatedField, ...]

    def run(self, spark, start=None, end=None) -> Scalars:
        r = self.source.run(spark, start, end)
        return _scalars(r.df, [self._bound(r, one) for one in self.fields])

    def _bound(self, r: Report, one: AggregatedField):
        check_reduction(one.reduction)
        if one.source is None:
            raise QueryError("a report's aggregation names its field")
        k = r.index(one.source)
        meta, other = r.metas[k], None
        if one.reduction in PAIRED:
            if not one.compare:
                raise QueryError(f"{one.reduction} needs a field to compare with")
            j = r.index(one.compare)
            if not r.metas[j].numeric:
                raise QueryError(f"{one.reduction} needs numbers, not {r.metas[j].data_type}")
            other = F.col(f"f{j}")
        elif one.compare:
            raise QueryError(f"{one.reduction} compares nothing")
        check_source(one.reduction, meta)
        return one, meta, F.col(f"f{k}"), other


@dataclass(frozen=True)
class Composite(Aggregation):
    """The results of several aggregations side by side; those of one source are one pass over it."""

    parts: tuple[Aggregation, ...]

    def run(self, spark, start=None, end=None) -> Scalars:
        if not self.parts:
            raise QueryError("a composite needs an aggregation")
        found = [p.run(spark, start, end) for p in self._merged()]
        metas = distinct_urns([m for s in found for m in s.metas])
        at, frames = 0, []
        for s in found:
            n = len(s.metas)
            frames.append(s.df.select(*[F.col(f"{x}{k}").alias(f"{x}{at + k}") for k in range(n) for x in "vt"]))
            at += n
        return Scalars(metas, reduce(lambda a, b: a.crossJoin(b), frames))  # one row each

    def _merged(self) -> list[Aggregation]:
        out: list[Aggregation] = []
        for p in self.parts:
            last = out[-1] if out else None
            named = isinstance(p, FromReport) and all(f.new for f in p.fields)
            if named and isinstance(last, FromReport) and last.source == p.source and all(f.new for f in last.fields):
                out[-1] = FromReport(p.source, last.fields + p.fields)
            else:
                out.append(p)
        return out


@dataclass(frozen=True)
class FromExpressions(Aggregation):
    """Scalars computed from another aggregation's; the source's own are not passed on."""

    source: Aggregation
    fields: tuple[tuple[Expr, NewField], ...]

    def run(self, spark, start=None, end=None) -> Scalars:
        found = self.source.run(spark, start, end)
        scope = Scope(None, {m.urn: (m, F.col(f"v{k}")) for k, m in enumerate(found.metas)})
        metas, cols = [], []
        for k, (value, new) in enumerate(self.fields):
            meta, column = value.bind(scope)
            metas.append(new.of(meta))
            cols += [column.alias(f"v{k}"), F.lit(None).cast("timestamp").alias(f"t{k}")]
        distinct_urns(metas)
        return Scalars(metas, found.df.select(*cols))
