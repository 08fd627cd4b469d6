"""Scalar expressions, checked and typed before they become columns.

``bind`` takes a scope (the row's timestamp and its fields) and gives the value's metadata and column.
The same nodes serve series (one unnamed field), reports (named fields) and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import FieldMeta, QueryError, ValueMeta, check_type, merged, spark_type
from .periods import check_zone, local
from .reductions import across, check_reduction, reduced_meta

Bound = tuple[ValueMeta, Column]


@dataclass(frozen=True)
class Scope:
    """Fields by name; a series' only field has the name None as well."""

    ts: Column | None
    fields: dict[str | None, tuple[FieldMeta | ValueMeta, Column]]

    def field(self, urn: str | None) -> Bound:
        if urn not in self.fields:
            raise QueryError(f"unknown field {urn!r}")
        return self.fields[urn]


class Expr:
    def bind(self, scope: Scope) -> Bound:
        raise NotImplementedError

    def refs(self) -> set[str]:
        """Names of the fields it reads."""
        found: set[str] = set()
        for v in vars(self).values():
            found |= v.refs() if isinstance(v, Expr) else set()
        return found


def parse_constant(value: Any, data_type: str) -> Any:
    """A constant's value as the Python type of ``data_type``."""
    try:
        if value is None:
            return None
        if data_type == "integer":
            if isinstance(value, float) and not value.is_integer():
                raise ValueError("not whole")
            return int(value)
        if data_type == "decimal":
            return float(value)
        if data_type == "boolean":
            if isinstance(value, bool):
                return value
            # The texts that are booleans.
            return {"1": True, "t": True, "T": True, "true": True, "TRUE": True, "True": True, "0": False, "f": False, "F": False, "false": False, "FALSE": False, "False": False}[str(value)]
        if data_type == "timestamp":
            return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
        return str(value)
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError(f"{value!r} is no {data_type}") from e


@dataclass(frozen=True)
class Constant(Expr):
    value: Any
    data_type: str
    required: bool = True
    unit: str = ""

    def bind(self, scope: Scope) -> Bound:
        meta = ValueMeta(self.data_type, self.required, self.unit)
        value = parse_constant(self.value, self.data_type)
        if value is None and self.required:
            raise QueryError("a required constant is null")
        return meta, F.lit(value).cast(spark_type(self.data_type))


@dataclass(frozen=True)
class Nil(Expr):
    """A typed null."""

    data_type: str
    unit: str = ""

    def bind(self, scope: Scope) -> Bound:
        return ValueMeta(self.data_type, False, self.unit), F.lit(None).cast(spark_type(self.data_type))


@dataclass(frozen=True)
class Ref(Expr):
    urn: str | None = None

    def bind(self, scope: Scope) -> Bound:
        meta, column = scope.field(self.urn)
        return (meta.value if isinstance(meta, FieldMeta) else meta), column

    def refs(self) -> set[str]:
        return {self.urn} if self.urn is not None else set()


@dataclass(frozen=True)
class RowTimestamp(Expr):
    def bind(self, scope: Scope) -> Bound:
        if scope.ts is None:
            raise QueryError("there is no row timestamp here")
        return ValueMeta("timestamp"), scope.ts


# How each part of a timestamp is taken, of the local time but for the last.
PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "dayOfYear": F.dayofyear,
    "dayOfMonth": F.dayofmonth,
    "dayOfWeek": lambda ts: F.weekday(ts) + 1,
    "hour": F.hour,
    "minute": F.minute,
    "epochMillis": F.unix_millis,
}


@dataclass(frozen=True)
class TimestampExtract(Expr):
    source: Expr
    part: str
    zone: str | None = None

    def bind(self, scope: Scope) -> Bound:
        meta, column = self.source.bind(scope)
        if meta.data_type != "timestamp":
            raise QueryError(f"cannot take {self.part} of a {meta.data_type}")
        if self.part not in PARTS:
            raise QueryError(f"unknown part of a timestamp {self.part!r}")
        zone = check_zone(self.zone)
        at = column if self.part == "epochMillis" else local(column, zone)
        return ValueMeta("integer", meta.required), PARTS[self.part](at).cast("long")


def decimal_text(x: Column) -> Column:
    """The shortest decimal text without an exponent."""
    s = x.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(s, "^-", "")
    mantissa, power = F.substring_index(body, "E", 1), F.substring_index(body, "E", -1).try_cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, part)
    after = F.length(part)
    large = F.when(power >= after, F.concat(digits, F.repeat(F.lit("0"), power - after))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(400))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.regexp_replace(body, r"\.0$", "")
    return F.when(s.rlike("^-?[0-9.]+$"), F.concat(sign, plain)).when(s.rlike("E"), F.concat(sign, F.when(power >= 0, large).otherwise(small))).otherwise(s)


@dataclass(frozen=True)
class Cast(Expr):
    source: Expr
    target: str

    def bind(self, scope: Scope) -> Bound:
        meta, column = self.source.bind(scope)
        check_type(self.target)
        out = meta.but(data_type=self.target)
        if meta.data_type == self.target:
            return out, column
        if "boolean" in (meta.data_type, self.target) or "timestamp" in (meta.data_type, self.target):
            raise QueryError(f"cannot cast {meta.data_type} to {self.target}")
        if self.target == "string":
            return out, decimal_text(column) if meta.data_type == "decimal" else column.cast("string")
        if meta.data_type == "string":
            number = column.try_cast(spark_type(self.target))
            wrong = column.isNotNull() & number.isNull()
            return out, F.when(wrong, F.raise_error(F.concat(F.lit(f"no {self.target}: "), column)).cast(spark_type(self.target))).otherwise(number)
        return out, column.cast(spark_type(self.target))


def _or_error(divisor: Column, quotient: Column, kind: str) -> Column:
    return F.when(divisor == 0, F.raise_error(F.lit("division by zero")).cast(kind)).otherwise(quotient)


def _numeric(op: str, a: Column, b: Column, integers: bool) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return _or_error(b, F.call_function("div", a, F.nullif(b, F.lit(0))), "long") if integers else _or_error(b, a / F.nullif(b, F.lit(0.0)), "double")
    if op == "%":
        return _or_error(b, a % F.nullif(b, F.lit(0)), "long")
    if op == "^":
        return F.pow(a, b).cast("long") if integers else F.pow(a, b)
    raise QueryError(f"unknown numeric operator {op!r}")




@dataclass(frozen=True)
class Numeric(Expr):
    first: Expr
    op: str
    second: Expr

    def bind(self, scope: Scope) -> Bound:
        (a, x), (b, y) = self.first.bind(scope), self.second.bind(scope)
        op = self.op
        if not a.numeric or not b.numeric:
            raise QueryError(f"{op} needs numbers, not {a.data_type} and {b.data_type}")
        integers = a.data_type == b.data_type == "integer"
        if op == "%" and not integers:
            raise QueryError("% needs integers")
        if not integers:
            x, y = x.cast("double"), y.cast("double")
        unit = a.unit if a.unit == b.unit else ""
        meta = ValueMeta("integer" if integers else "decimal", a.required and b.required, unit, a.kind, a.sample_period, merged(a.custom, b.custom))
        return meta, _numeric(op, x, y, integers)


# Unary operators: those of integers, and of decimals.
OF_INTEGERS: dict[str, Callable[[Column], Column]] = {"abs": F.abs, "negate": F.negative, "sqrt": lambda x: F.sqrt(x).cast("long")}
OF_DECIMALS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "negate": F.negative,
    "sqrt": F.sqrt,
    "ceil": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
    "round": lambda x: F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)).cast("double"),
    "log": lambda x: _log(x, F.ln),
    "log10": lambda x: _log(x, F.log10),
    "exp": F.exp,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
}


def _log(x: Column, log: Callable[[Column], Column]) -> Column:
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(log(x))


@dataclass(frozen=True)
class Unary(Expr):
    operand: Expr
    op: str

    def bind(self, scope: Scope) -> Bound:
        meta, x = self.operand.bind(scope)
        if not meta.numeric:
            raise QueryError(f"{self.op} needs a number, not a {meta.data_type}")
        known = OF_INTEGERS if meta.data_type == "integer" else OF_DECIMALS
        if self.op not in known:
            raise QueryError(f"unsupported operator {self.op!r} for {meta.data_type}")
        return meta, known[self.op](x)


# Comparisons by their names in queries.
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "equals": lambda a, b: a == b,
    "not_equals": lambda a, b: a != b,
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
    "greater_equal": lambda a, b: a >= b,
    "less_equal": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Condition(Expr):
    """A comparison; false where an operand is null, whatever the operator."""

    op: str
    first: Expr
    second: Expr

    def bind(self, scope: Scope) -> Bound:
        (a, x), (b, y) = self.first.bind(scope), self.second.bind(scope)
        if self.op not in COMPARISONS:
            raise QueryError(f"unknown comparison {self.op!r}")
        if a.data_type != b.data_type and not (a.numeric and b.numeric):
            raise QueryError(f"cannot compare {a.data_type} with {b.data_type}")
        if a.data_type in ("string", "boolean") and self.op not in ("equals", "not_equals"):
            raise QueryError(f"{self.op} does not order a {a.data_type}")
        if a.data_type != b.data_type:
            x, y = x.cast("double"), y.cast("double")
        found = COMPARISONS[self.op](x, y)
        if a.data_type == "decimal" or b.data_type == "decimal":  # a NaN equals nothing and orders with nothing
            found = F.when(F.isnan(x.cast("double")) | F.isnan(y.cast("double")), F.lit(self.op == "not_equals")).otherwise(found)
            found = F.when(x.isNull() | y.isNull(), F.lit(False)).otherwise(found)
        return ValueMeta("boolean", a.required and b.required), F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Logical(Expr):
    op: str
    first: Expr
    second: Expr

    def bind(self, scope: Scope) -> Bound:
        both = [self.first.bind(scope), self.second.bind(scope)]
        if self.op not in ("and", "or"):
            raise QueryError(f"unknown logical operator {self.op!r}")
        for meta, _ in both:
            if meta.data_type != "boolean" or not meta.required:
                raise QueryError(f"{self.op} needs required booleans")
        (_, x), (_, y) = both
        return ValueMeta("boolean"), x & y if self.op == "and" else x | y


@dataclass(frozen=True)
class Selector(Expr):
    """One of two values, by a condition; the other one is not evaluated."""

    condition: Expr
    if_true: Expr
    if_false: Expr

    def bind(self, scope: Scope) -> Bound:
        chosen, when = self.condition.bind(scope)
        if chosen.data_type != "boolean" or not chosen.required:
            raise QueryError("a selector needs a required boolean")
        (a, x), (b, y) = self.if_true.bind(scope), self.if_false.bind(scope)
        for name in ("data_type", "unit", "required"):
            if getattr(a, name) != getattr(b, name):
                raise QueryError(f"a selector's branches differ in {name}: {getattr(a, name)!r} and {getattr(b, name)!r}")
        if a.kind and b.kind and a.kind != b.kind:
            raise QueryError(f"a selector's branches differ in metric kind: {a.kind} and {b.kind}")
        return a.but(kind=a.kind or b.kind, custom=merged(a.custom, b.custom)), F.when(when, x).otherwise(y)


@dataclass(frozen=True)
class Nvl(Expr):
    """A value, or where it is null another one that never is."""

    source: Expr
    alternative: Expr

    def bind(self, scope: Scope) -> Bound:
        (a, x), (b, y) = self.source.bind(scope), self.alternative.bind(scope)
        if a.data_type != b.data_type:
            raise QueryError(f"nvl of {a.data_type} and {b.data_type}")
        if not b.required:
            raise QueryError("nvl needs a required alternative")
        return a.but(required=True), x if a.required else F.coalesce(x, y)


@dataclass(frozen=True)
class ReduceFields(Expr):
    """A reduction across the fields of a report's row; of all fields if none are named."""

    reduction: str
    urns: tuple[str, ...] | None = None

    def bind(self, scope: Scope) -> Bound:
        check_reduction(self.reduction, paired=False)
        named = {u: b for u, b in scope.fields.items() if u is not None}
        missing = [u for u in self.urns or () if u not in named]
        if missing:
            raise QueryError(f"cannot reduce unknown fields {missing}")
        chosen = [b for u, b in named.items() if self.urns is None or u in self.urns]
        if not chosen:
            raise QueryError("no fields to reduce")
        metas = [m for m, _ in chosen]
        for m in metas:
            if m.data_type != metas[0].data_type or not m.required:
                raise QueryError("fields to reduce must be required and of one type")
        meta = reduced_meta(self.reduction, metas)
        return meta, across(self.reduction, [c for _, c in chosen], meta.data_type)

    def refs(self) -> set[str]:
        return set(self.urns or ())


def required_boolean(expr: Expr, scope: Scope, what: str) -> Column:
    meta, column = expr.bind(scope)
    if meta.data_type != "boolean":
        raise QueryError(f"{what} needs a boolean, not a {meta.data_type}")
    if not meta.required:
        raise QueryError(f"{what} needs a required boolean")
    return column


