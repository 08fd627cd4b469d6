"""Reductions: over rows (aggregates), and across the columns of one row.

Nulls are skipped; all but the count are null where nothing is left. Percentiles are exact, linear
between the neighbours of the index p * (n - 1); ``approx`` takes Spark's sketch instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import QueryError, ValueMeta, merged, spark_type

# The reductions by name; percentiles with their share.
PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
SINGLE = ("sum", "avg", "min", "max", "count", "first", "last", "stddev", "variance", "spread", *PERCENTILES)
PAIRED = ("mae", "rmse", "mbe", "mape", "pearson", "r2")
ANY_TYPE = ("count", "first", "last")
TIMED = ("min", "max", "first", "last")


def check_reduction(name: str, paired: bool | None = None) -> str:
    if name not in SINGLE + PAIRED:
        raise QueryError(f"unknown reduction {name!r}")
    if paired is False and name in PAIRED:
        raise QueryError(f"{name} compares two fields")
    if paired is True and name not in PAIRED:
        raise QueryError(f"{name} takes one field")
    return name


def result_type(name: str, source: str) -> str:
    if name == "count":
        return "integer"
    return source if name in ("sum", "min", "max", "first", "last", "spread") else "decimal"


def check_source(name: str, meta: ValueMeta) -> None:
    if name not in ANY_TYPE and not meta.numeric:
        raise QueryError(f"{name} needs numbers, not {meta.data_type}")


def reduced_unit(name: str, unit: str) -> str:
    return {"count": "", "pearson": "", "r2": "", "mape": "percent"}.get(name, unit)


def reduced_meta(name: str, metas: list[ValueMeta]) -> ValueMeta:
    """Of a reduction across several values: kind and period of the first, a unit that all share."""
    first = metas[0]
    check_source(name, first)
    unit = reduced_unit(name, first.unit if all(m.unit == first.unit for m in metas) else "")
    return ValueMeta(result_type(name, first.data_type), True, unit, first.kind, first.sample_period, merged(*[m.custom for m in metas]))


def over_rows(name: str, value: Column, order: Column, data_type: str, approx: bool = False) -> Column:
    """The aggregate of a column's rows; ``order`` ranks rows in time."""
    if name in PERCENTILES:
        share = F.lit(PERCENTILES[name])
        return (F.percentile_approx(value.cast("double"), PERCENTILES[name], 10_000) if approx else F.percentile(value.cast("double"), share)).cast("double")
    if name == "first":
        return F.min_by(value, F.when(value.isNotNull(), order))
    if name == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    plain = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_pop, "variance": F.var_pop}
    found = F.max(value) - F.min(value) if name == "spread" else plain[name](value)
    return found.cast(spark_type(result_type(name, data_type)))


def time_of(name: str, value: Column, ts: Column, order: Column) -> Column | None:
    """When the reduction's value occurred: the earliest extreme, the first or the last; else nothing."""
    known = value.isNotNull()
    if name == "min":
        return F.min_by(ts, F.when(known, F.struct(value, order)))
    if name == "max":  # of equal values the one furthest from the future
        best = F.max(F.when(known, F.struct(value.alias("v"), (-F.unix_micros(ts)).alias("t"))))
        return F.timestamp_micros(-best["t"])
    if name == "first":
        return F.min_by(ts, F.when(known, order))
    return F.max_by(ts, F.when(known, order)) if name == "last" else None


def paired(name: str, actual: Column, predicted: Column) -> Column:
    """A forecast error; rows with a null on either side are skipped."""
    both = actual.isNotNull() & predicted.isNotNull()
    a, p = F.when(both, actual.cast("double")), F.when(both, predicted.cast("double"))
    error = a - p
    if name == "mae":
        return F.avg(F.abs(error))
    if name == "rmse":
        return F.sqrt(F.avg(error * error))
    if name == "mbe":
        return F.avg(error)
    if name == "mape":
        return 100 * F.avg(F.when(a != 0, F.abs(error / F.nullif(a, F.lit(0.0)))))
    if name == "pearson":
        return F.when(F.count(a) >= 2, F.covar_pop(a, p) / F.nullif(F.stddev_pop(a) * F.stddev_pop(p), F.lit(0.0)))
    if name == "r2":
        return F.when(F.count(a) >= 2, 1 - F.sum(error * error) / F.nullif(F.count(a) * F.var_pop(a), F.lit(0.0)))
    raise QueryError(f"unknown paired reduction {name!r}")


def _plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def across(name: str, columns: list[Column], out: str) -> Column:
    """The reduction of one row's values, which are not null unless partial; nulls are skipped.

    Plain arithmetic on the columns, which stays in generated code; only percentiles make an array.
    """
    n = _plus([F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    some = F.nullif(n, F.lit(0))
    if name == "count":
        found = n
    elif name in ("first", "last"):
        found = F.coalesce(*(columns if name == "first" else reversed(columns)))
    elif name == "sum":
        found = F.when(n > 0, _plus([F.coalesce(c, F.lit(0)) for c in columns]))
    elif name in ("min", "max", "spread"):
        low, high = (columns[0], columns[0]) if len(columns) == 1 else (F.least(*columns), F.greatest(*columns))
        found = {"min": low, "max": high}.get(name, high - low)
    elif name in ("avg", "variance", "stddev"):
        values = [c.cast("double") for c in columns]
        found = _plus([F.coalesce(v, F.lit(0.0)) for v in values]) / some
        if name != "avg":
            found = _plus([F.coalesce((v - found) * (v - found), F.lit(0.0)) for v in values]) / some
            found = F.sqrt(found) if name == "stddev" else found
    elif name in PERCENTILES:
        ranked, at = F.sort_array(F.array(*columns)), (n - 1) * F.lit(PERCENTILES[name])  # nulls come first
        skip = F.lit(len(columns)) - n
        low = F.get(ranked, (F.floor(at) + skip).cast("int")).cast("double")
        high = F.get(ranked, (F.ceil(at) + skip).cast("int")).cast("double")
        found = F.when(n > 0, low + (high - low) * (at - F.floor(at)))
    else:
        raise QueryError(f"{name} does not reduce across values")
    return found.cast(spark_type(out))
