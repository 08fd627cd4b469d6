"""One field over time: sources and filters of the series layer.

A series is a DataFrame of (ts, value, seq), ``seq`` telling rows of equal time apart, and its field's
metadata. Nodes check everything they can when they run, which starts no Spark job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Constant, Expr, Scope, required_boolean
from ..functions.ordered import DAY_US, chunk_of, neighbour, neighbours
from ..functions.periods import Period
from ..functions.reductions import check_reduction, check_source, over_rows, result_type
from ..meta import FieldMeta, NewField, QueryError, merged, spark_type
from .schedule import Schedule


@dataclass(frozen=True)
class Series:
    """``unique``: whether no two rows share a time."""

    meta: FieldMeta
    df: DataFrame
    unique: bool = False

    def scope(self) -> Scope:
        bound = (self.meta, F.col("value"))
        return Scope(F.col("ts"), {None: bound, self.meta.urn: bound})

    def but(self, df: DataFrame | None = None, meta: FieldMeta | None = None, unique: bool | None = None) -> Series:
        return Series(meta or self.meta, self.df if df is None else df, self.unique if unique is None else unique)

    def result(self) -> DataFrame:
        """(ts, value), the metadata attached to the value's column."""
        return self.df.select("ts", F.col("value").alias("value", metadata=self.meta.as_json()))


class Datasource:
    def run(self, spark: SparkSession, start: datetime | None = None, end: datetime | None = None) -> Series:
        raise NotImplementedError

    def try_filter(self, one: SeriesFilter) -> Datasource | None:
        """Itself with a filter taken in, where the source can do its work; else nothing."""
        return None


def in_range(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows of [start, end); a filter on the scan's own column, so it is pushed down."""
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start))
    return df if end is None else df.filter(F.col("ts") < F.lit(end))


@dataclass(frozen=True)
class StaticSeries(Datasource):
    """Rows given in the query: (timestamp, value)."""

    meta: FieldMeta
    rows: Sequence[tuple[datetime, Any]] = field(hash=False)

    def run(self, spark, start=None, end=None) -> Series:
        kind = spark_type(self.meta.data_type)
        if self.meta.required and any(v is None for _, v in self.rows):
            raise QueryError(f"{self.meta.urn}: a required value is null")
        cast = float if self.meta.data_type == "decimal" else (lambda v: v)
        rows = [(t, None if v is None else cast(v), k) for k, (t, v) in enumerate(self.rows)]
        df = spark.createDataFrame(rows, f"ts timestamp, value {kind}, seq long")
        return Series(self.meta, in_range(df, start, end))


@dataclass(frozen=True)
class TableSeries(Datasource):
    """A field of a table: ``make`` gives the DataFrame; times without a zone are read as UTC."""

    meta: FieldMeta
    make: Callable[[SparkSession], DataFrame] = field(hash=False)
    ts: str = "ts"
    value: str = "value"
    seq: str | None = None
    where: str | None = None
    unique: bool = False

    def run(self, spark, start=None, end=None) -> Series:
        df = self.make(spark)
        if self.where:
            df = df.filter(self.where)
        seq = F.col(self.seq).cast("long") if self.seq else F.lit(0).cast("long")
        df = df.select(F.col(self.ts).cast("timestamp").alias("ts"), F.col(self.value).cast(spark_type(self.meta.data_type)).alias("value"), seq.alias("seq"))
        return Series(self.meta, in_range(df, start, end), self.unique)


class SeriesFilter:
    def apply(self, series: Series) -> Series:
        raise NotImplementedError


@dataclass(frozen=True)
class FilteredSeries(Datasource):
    source: Datasource
    filters: tuple[SeriesFilter, ...]

    def run(self, spark, start=None, end=None) -> Series:
        source, rest = self.source, list(self.filters)
        while rest and (taken := source.try_filter(rest[0])) is not None:  # stops at the first that is refused
            source = taken
            rest.pop(0)
        found = source.run(spark, start, end)
        for one in rest:
            found = one.apply(found)
        return found


@dataclass(frozen=True)
class ConditionFilter(SeriesFilter):
    condition: Expr

    def apply(self, series: Series) -> Series:
        return series.but(series.df.filter(required_boolean(self.condition, series.scope(), "a condition filter")))


@dataclass(frozen=True)
class FieldValueFilter(SeriesFilter):
    value: Expr
    new: NewField

    def apply(self, series: Series) -> Series:
        meta, column = self.value.bind(series.scope())
        return series.but(series.df.withColumn("value", column), self.new.of(meta))


@dataclass(frozen=True)
class OverrideMeta(SeriesFilter):
    """Metadata only; what is not given stays, custom metadata is replaced."""

    urn: str | None = None
    unit: str | None = None
    kind: str | None = None
    sample_period: int | None = None
    custom: dict | None = field(default=None, hash=False)

    def apply(self, series: Series) -> Series:
        given = {k: v for k, v in vars(self).items() if v is not None}
        return series.but(meta=replace(series.meta, **given))


@dataclass(frozen=True)
class TimeShift(SeriesFilter):
    """Moves times; rows are not held against the query's range again."""

    seconds: int

    def __post_init__(self):
        if self.seconds == 0:
            raise QueryError("a time shift must not be zero")

    def shifted(self, ts: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(ts) + self.seconds * 1_000_000)

    def apply(self, series: Series) -> Series:
        return series.but(series.df.withColumn("ts", self.shifted(F.col("ts"))))


@dataclass(frozen=True)
class ScheduleFilter(SeriesFilter):
    schedule: Schedule

    def apply(self, series: Series) -> Series:
        return series.but(series.df.filter(self.schedule.matches(F.col("ts"))))


# ---------------------------------------------------------------- alignment


def check_fill(mode: str | None) -> str | None:
    if mode not in (None, "linear", "forwardFill"):
        raise QueryError(f"unknown fill mode {mode!r}")
    return mode


def between(x0: Column, x1: Column, t0: Column, t1: Column, t: Column, kind: str) -> Column:
    """The value at t on the line from (t0, x0) to (t1, x1); integers truncate."""
    a, b, c = F.unix_micros(t0), F.unix_micros(t1), F.unix_micros(t)
    share = (c - a).cast("double") / F.nullif((b - a).cast("double"), F.lit(0.0))
    return (x0.cast("double") + (x1.cast("double") - x0.cast("double")) * share).cast(kind)


def bucket_chunk(period: Period) -> Column:
    """Chunks of about a thousand buckets."""
    return chunk_of(F.col("ts"), max(DAY_US, period.about_us * 1024))


def aligned_columns(df: DataFrame, period: Period, fields: dict[str, tuple[FieldMeta, str | None]]) -> DataFrame:
    """A row a bucket: each field reduced, or brought to the bucket's start on the line to its first row.

    ``fields``: column to (metadata, reduction or None). Rows are aggregated to buckets first; only
    buckets are looked at in order.
    """
    order = F.struct("ts", "seq")
    rows = df.withColumn("bucket", period.bucket(F.col("ts")))
    aggs, lines = [], [c for c, (_, r) in fields.items() if r is None]
    for c, (meta, reduction) in fields.items():
        if reduction is not None:
            aggs.append(over_rows(reduction, F.col(c), order, meta.data_type).alias(c))
    if lines:
        at = F.struct("ts", *lines)
        aggs += [F.min_by(at, order).alias("first"), F.max_by(at, order).alias("last")]
    found = rows.groupBy("bucket").agg(*aggs).withColumnRenamed("bucket", "ts")
    if lines:
        found = neighbour(found, ["ts"], F.col("last"), "before", bucket_chunk(period))
        for c in lines:
            meta = fields[c][0]
            first, kind = F.col("first")[c], spark_type(meta.data_type)
            plain = F.col("before").isNull() | (F.col("first")["ts"] == F.col("ts"))
            if meta.numeric:
                x0, x1 = F.col("before")[c], first
                line = between(x0, x1, F.col("before")["ts"], F.col("first")["ts"], F.col("ts"), kind)
                if meta.required:
                    line = F.when(x0.isNull() | x1.isNull(), F.raise_error(F.lit(f"{meta.urn}: a required value is null")).cast(kind)).otherwise(line)
                value = F.when(plain, first).otherwise(line)
            else:
                value = first
            found = found.withColumn(c, value)
    return found.select("ts", *fields)


#: Buckets that one task makes at a time.
BLOCK = 4096


def grid(ends: DataFrame, period: Period) -> DataFrame:
    """(ts) of the buckets numbered from ``a`` to ``b`` of one row, made in blocks that are dealt over tasks."""
    ends = ends.filter("a <= b")
    blocks = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / BLOCK).cast("long"))).alias("k"), "a", "b").repartition(F.col("k"))
    numbers = blocks.select(F.explode(F.sequence(F.col("a") + F.col("k") * BLOCK, F.least(F.col("b"), F.col("a") + (F.col("k") + 1) * BLOCK - 1))).alias("n"))
    return numbers.select(period.start(F.col("n")).alias("ts"))


def filled(df: DataFrame, period: Period, modes: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each bucket from the first to the last; ``modes``: column to (mode, Spark type)."""
    both = grid(df.agg(F.min(period.index(F.col("ts"))).alias("a"), F.max(period.index(F.col("ts"))).alias("b")), period)
    both = both.join(df.withColumn("known", F.lit(True)), "ts", "left")
    names = list(modes)
    taken = F.struct("ts", *names)
    known, chunk = F.col("known").isNotNull(), bucket_chunk(period)
    linear = any(m == "linear" for m, _ in modes.values())
    both = neighbours(both, ["ts"], taken, chunk, "prev", "next" if linear else None, known)
    for c, (mode, kind) in modes.items():
        if mode == "linear":
            made = between(F.col("prev")[c], F.col("next")[c], F.col("prev")["ts"], F.col("next")["ts"], F.col("ts"), kind)
        else:
            made = F.col("prev")[c]
        both = both.withColumn(c, F.when(known, F.col(c)).otherwise(made))
    return both.select("ts", *names)


@dataclass(frozen=True)
class Aligner(SeriesFilter):
    """Rows to the starts of a period's buckets: a reduction, or else interpolation; then optionally the gaps."""

    period: Period
    fill: str | None = None
    reduction: str | None = None

    def reduction_for(self, meta: FieldMeta) -> str | None:
        if self.reduction:
            check_reduction(self.reduction, paired=False)
            check_source(self.reduction, meta)
            return self.reduction
        return "sum" if meta.metric_kind == "delta" else None

    def apply(self, series: Series) -> Series:
        meta, reduction = series.meta, self.reduction_for(series.meta)
        if reduction == "sum":
            check_source("sum", meta)
        out = replace(meta, data_type=result_type(reduction, meta.data_type)) if reduction else meta
        if reduction == "count":
            out = replace(out, unit="", required=True)
        if self.period.fixed_us:
            out = replace(out, sample_period=self.period.fixed_us)
        if check_fill(self.fill) and not out.numeric:
            raise QueryError("only numbers can be filled in")
        df = aligned_columns(series.df, self.period, {"value": (meta, reduction)})
        if reduction:
            kind = spark_type(out.data_type)
            df = df.withColumn("value", F.coalesce("value", F.raise_error(F.lit(f"{meta.urn}: a bucket has no value")).cast(kind)))
        if self.fill:
            df = filled(df, self.period, {"value": (self.fill, spark_type(out.data_type))})
        return Series(out, df.withColumn("seq", F.lit(0).cast("long")), True)


# ---------------------------------------------------------------- deltas and rates


@dataclass(frozen=True)
class Counter:
    """How a counter's readings are taken: resets, wraps and gaps."""

    non_negative: bool = False
    max_counter: float | None = None
    emit_on_reset: bool = False
    max_gap: int | None = None

    def __post_init__(self):
        if not self.non_negative and (self.max_counter is not None or self.emit_on_reset):
            raise QueryError("a counter's largest value and emitting on a reset need nonNegative")
        if self.max_counter is not None and self.emit_on_reset:
            raise QueryError("a counter either wraps or is emitted on a reset")
        if self.max_gap is not None and self.max_gap <= 0:
            raise QueryError("a gap must be positive")

    def steps(self, series: Series) -> DataFrame:
        """(ts, seq, delta, us) of the rows that have a baseline: the difference and the microseconds to it.

        A negative reading does not become a baseline unless it is the first or follows a gap, so the
        baseline of a row is the last one before it that may set one; with a gap limit the negative
        readings between two others are folded in order.
        """
        gap = self.max_gap or (2 * series.meta.sample_period if series.meta.sample_period else None)
        df, at, chunk = series.df, F.struct("ts", "value"), chunk_of(F.col("ts"))
        order = ["ts", "seq"]
        if not self.non_negative:
            rows = neighbour(df, order, at, "base", chunk)
        else:
            first = df.agg(F.min(F.struct("ts", "seq")).alias("f")).select("f.ts", "f.seq", F.lit(True).alias("first"))  # one row
            marked = df.join(F.broadcast(first), ["ts", "seq"], "left").withColumn("sets", (F.col("value") >= 0) | F.col("first").isNotNull()).drop("first")
            rows = neighbour(marked, order, F.struct("ts", "seq", "value"), "base", chunk, F.col("sets"))
            if gap:
                rows = low_folded(rows.filter("base IS NOT NULL"), gap)
        us = F.unix_micros("ts") - F.unix_micros(F.col("base")["ts"])
        rows = rows.filter("base IS NOT NULL")
        if gap:
            rows = rows.filter(us <= gap)
        if self.non_negative:
            rows = rows.filter("value >= 0")
        now, was = F.col("value"), F.col("base")["value"]
        delta = now - was
        if self.non_negative:
            kind = spark_type(series.meta.data_type)
            if self.max_counter is not None:
                less = (F.lit(self.max_counter).cast(kind) - was) + now
            else:
                less = now if self.emit_on_reset else F.lit(0).cast(kind)
            delta = F.when(now < was, less).otherwise(delta)
        return rows.select("ts", "seq", delta.alias("delta"), us.alias("us"))


def low_folded(rows: DataFrame, gap: int) -> DataFrame:
    """(ts, seq, value, base) of the rows that set a baseline, ``base`` moved on by the readings below zero since.

    ``rows``: (ts, seq, value, sets, base). A reading below zero that is more than ``gap`` microseconds from the
    baseline takes its place. A baseline's rows are streamed in order of time, with one baseline held, so
    however long a series stays below zero no task holds it.
    """
    kind = rows.schema["value"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = at = value = None
        for batch in batches:
            b_us, b_seq, us, seq = (batch.column(k).to_numpy() for k in range(4))
            low, b_value, values = ~batch.column(4).to_numpy(zero_copy_only=False), batch.column(5), batch.column(6)
            n, k, out = batch.num_rows, 0, []
            first = np.flatnonzero(np.append(True, (b_us[1:] != b_us[:-1]) | (b_seq[1:] != b_seq[:-1]))) if n else []
            for k, end in zip(first, [*first[1:], n], strict=True):
                if own != (b_us[k], b_seq[k]):
                    own, at, value = (b_us[k], b_seq[k]), b_us[k], b_value[int(k)].as_py()
                lows = np.flatnonzero(low[k:end]) + k
                times = us[lows]
                while len(times) and (j := int(np.searchsorted(times, at + gap, "right"))) < len(times):
                    at, value = times[j], values[int(lows[j])].as_py()
                    lows, times = lows[j + 1 :], times[j + 1 :]
                out += [(int(us[i]), int(seq[i]), values[int(i)].as_py(), int(at), value) for i in np.flatnonzero(~low[k:end]) + k]
            types = [pa.int64(), pa.int64(), values.type, pa.int64(), values.type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, types, strict=True)], names=["us", "seq", "value", "b_us", "b_value"])

    base = F.col("base")
    flat = rows.select(F.unix_micros(base["ts"]).alias("b_us"), base["seq"].alias("b_seq"), F.unix_micros("ts").alias("us"), "seq", "sets", base["value"].alias("b_value"), "value")
    flat = flat.repartition("b_us", "b_seq").sortWithinPartitions("b_us", "b_seq", "us", "seq")
    found = flat.mapInArrow(run, f"us long, seq long, value {kind}, b_us long, b_value {kind}")
    return found.select(F.timestamp_micros("us").alias("ts"), "seq", "value", F.struct(F.timestamp_micros("b_us").alias("ts"), F.col("b_value").alias("value")).alias("base"))


def _counted(series: Series, what: str) -> None:
    if not series.meta.numeric:
        raise QueryError(f"{what} needs numbers, not {series.meta.data_type}")
    if not series.meta.required:
        raise QueryError(f"{what} needs a required field")


@dataclass(frozen=True)
class DeltaFilter(SeriesFilter):
    """Differences of a cumulative field."""

    counter: Counter = Counter()

    def apply(self, series: Series) -> Series:
        _counted(series, "a delta")
        if series.meta.metric_kind != "cumulative":
            raise QueryError(f"a delta needs a cumulative field, not {series.meta.metric_kind}")
        df = self.counter.steps(series).select("ts", F.col("delta").alias("value"), "seq")
        return series.but(df, replace(series.meta, kind="delta"))


@dataclass(frozen=True)
class RateFilter(SeriesFilter):
    """Differences by time, for each ``per_seconds`` seconds.

    ``no_time``: what a rate between two readings of one time is: "error", or "infinite", as division of
    doubles has it: an infinity of the difference's sign, NaN for no difference.
    """

    unit: str = ""
    per_seconds: int = 1
    counter: Counter = Counter()
    no_time: str = "error"

    def apply(self, series: Series) -> Series:
        _counted(series, "a rate")
        if self.no_time not in ("error", "infinite"):
            raise QueryError(f"a rate over no time is error or infinite, not {self.no_time!r}")
        if series.meta.metric_kind == "rate":
            raise QueryError("a rate of a rate")
        seconds = F.col("us") / 1e6
        if self.no_time == "infinite":
            none = F.when(F.col("delta") == 0, F.lit(float("nan"))).otherwise(F.signum("delta") * F.lit(float("inf")))
        else:
            none = F.raise_error(F.lit("a rate over no time")).cast("double")
        rate = F.when(F.col("us") == 0, none).otherwise(F.col("delta").cast("double") / F.nullif(seconds, F.lit(0.0)) * F.lit(float(self.per_seconds or 1)))
        df = self.counter.steps(series).select("ts", rate.alias("value"), "seq")
        meta = replace(series.meta, data_type="decimal", required=True, kind="rate", unit=self.unit, sample_period=None)
        return series.but(df, meta)


# ---------------------------------------------------------------- several series


class MultiDatasource:
    def members(self) -> list[Datasource]:
        raise NotImplementedError


@dataclass(frozen=True)
class ListSeries(MultiDatasource):
    sources: tuple[Datasource, ...]

    def members(self) -> list[Datasource]:
        return list(self.sources)


@dataclass(frozen=True)
class FilteredMany(MultiDatasource):
    """The same filters for each member."""

    source: MultiDatasource
    filters: tuple[SeriesFilter, ...]

    def members(self) -> list[Datasource]:
        return [FilteredSeries(m, self.filters) for m in self.source.members()]


def numbered(df: DataFrame, unique: bool) -> DataFrame:
    """``df`` with ``dup``: the how-many-th row of its time it is."""
    from pyspark.sql import Window as W

    return df.withColumn("dup", F.lit(1) if unique else F.row_number().over(W.partitionBy("ts").orderBy("seq")))


@dataclass(frozen=True)
class ReductionSeries(Datasource):
    """Several series reduced across at each time: of all of them, or with ``partial`` of those that have it."""

    reduction: str
    source: MultiDatasource
    aligner: Aligner | None = None
    new: NewField | None = None
    empty: Constant | None = None
    partial: bool = False

    def run(self, spark, start=None, end=None) -> Series:
        check_reduction(self.reduction, paired=False)
        if self.empty is not None and self.aligner is None:
            raise QueryError("a fallback value needs an aligner")
        members = self.source.members()
        if not members:
            return self._fallback(spark, start, end)
        if self.aligner:
            members = [FilteredSeries(m, (self.aligner,)) for m in members]
        found = [m.run(spark, start, end) for m in members]
        metas = [s.meta for s in found]
        for m in metas:
            if m.data_type != metas[0].data_type:
                raise QueryError("series to reduce must have one type")
            if not m.required:
                raise QueryError(f"{m.urn}: series to reduce must be required")
        check_source(self.reduction, metas[0])
        first, unit = metas[0], metas[0].unit if all(m.unit == metas[0].unit for m in metas) else ""
        meta = FieldMeta(result_type(self.reduction, first.data_type), True, "" if self.reduction == "count" else unit, first.kind, first.sample_period, merged(*[m.custom for m in metas]), first.urn)
        meta = self.new.of(meta) if self.new else meta
        kind = spark_type(meta.data_type)
        if len(found) == 1 and self.reduction not in ("count", "stddev", "variance", "spread"):  # of one value, the value
            one = found[0]
            return Series(meta, one.df.withColumn("value", F.col("value").cast(kind)), one.unique)
        rows = None
        for k, s in enumerate(found):
            part = numbered(s.df, s.unique).select("ts", "dup", F.lit(k).alias("k"), "value")
            rows = part if rows is None else rows.unionByName(part)
        value = over_rows(self.reduction, F.col("value"), F.col("k"), first.data_type)
        whole = rows.groupBy("ts", "dup").agg(value.alias("value"), F.count("*").alias("n"))
        if not self.partial:
            whole = whole.filter(F.col("n") == len(found))
        return Series(meta, whole.select("ts", "value", F.col("dup").cast("long").alias("seq")), all(s.unique for s in found))

    def _fallback(self, spark, start, end) -> Series:
        if self.empty is None:
            raise QueryError("no series to reduce")
        if start is None or end is None:
            raise QueryError("a fallback value needs a range of time")
        meta, column = self.empty.bind(Scope(None, {}))
        urn = self.new.urn if self.new else self.reduction
        df = aligned_timestamps(spark, self.aligner.period, start, end).select("ts", column.alias("value"), F.lit(0).cast("long").alias("seq"))
        return Series((self.new or NewField(urn)).of(meta), df, True)


def aligned_timestamps(spark: SparkSession, period: Period, start: datetime, end: datetime) -> DataFrame:
    """(ts) of each bucket from the one of ``start`` while before ``end``."""
    ends = spark.range(1).select(period.index(F.lit(start).cast("timestamp")).alias("a"), period.index(F.lit(end).cast("timestamp")).alias("b"))
    return grid(ends, period).filter(F.col("ts") < F.lit(end))


def align_delta(series: Series, period: Period) -> Series:
    """Aligned values and, unless it lies on a bound or is alone, the last raw row at its bucket's end; then differences."""
    meta = series.meta
    aligned = aligned_columns(series.df, period, {"value": (meta, None)})
    ends = series.df.agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "seq")).alias("z"), F.min("ts").alias("a"))
    last = ends.select(period.step(period.bucket(F.col("z.ts"))).alias("ts"), F.col("z.value").alias("value"), F.col("z.ts").alias("raw"), "a")
    last = last.filter((period.bucket(F.col("raw")) != F.col("raw")) & (F.col("raw") != F.col("a"))).select("ts", "value")
    both = aligned.unionByName(last)
    steps = neighbour(both, ["ts"], F.struct("value"), "base", bucket_chunk(period)).filter("base IS NOT NULL")
    df = steps.select("ts", (F.col("value") - F.col("base")["value"]).alias("value"), F.lit(0).cast("long").alias("seq"))
    return Series(replace(meta, kind="delta"), df, True)
