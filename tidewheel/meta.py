"""Types and metadata of series fields; everything here is known before a Spark job runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T


class QueryError(ValueError):
    """A query that is wrong whatever the data; raised while it is analysed."""


# The names of types and metric kinds in queries.
TYPES = {"integer": T.LongType(), "decimal": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
KINDS = ("gauge", "delta", "cumulative", "rate")
NUMERIC = ("integer", "decimal")


def check_type(name: str) -> str:
    if name not in TYPES:
        raise QueryError(f"invalid data type {name!r}")
    return name


def spark_type(name: str) -> str:
    return TYPES[check_type(name)].simpleString()


@dataclass(frozen=True)
class ValueMeta:
    """What is known of an expression's value. ``sample_period`` is in microseconds; a kind of None reads as gauge."""

    data_type: str
    required: bool = True
    unit: str = ""
    kind: str | None = None
    sample_period: int | None = None
    custom: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        check_type(self.data_type)
        if self.kind is not None and self.kind not in KINDS:
            raise QueryError(f"invalid metric kind {self.kind!r}")

    @property
    def numeric(self) -> bool:
        return self.data_type in NUMERIC

    @property
    def metric_kind(self) -> str:
        return self.kind or "gauge"

    def but(self, **changes) -> ValueMeta:
        return replace(self, **changes)

    def named(self, urn: str) -> FieldMeta:
        return FieldMeta(self.data_type, self.required, self.unit, self.kind, self.sample_period, self.custom, urn)


@dataclass(frozen=True)
class FieldMeta(ValueMeta):
    """A named field's metadata."""

    urn: str = ""

    def __post_init__(self):
        super().__post_init__()
        if not self.urn:
            raise QueryError("a field needs a non-empty urn")

    @property
    def value(self) -> ValueMeta:
        return ValueMeta(self.data_type, self.required, self.unit, self.kind, self.sample_period, self.custom)

    def as_json(self) -> dict[str, Any]:
        given = {"uri": self.urn, "dataType": self.data_type, "required": self.required, "unit": self.unit, "metricKind": self.metric_kind, "customMetadata": self.custom}
        return given | ({"samplePeriod": duration_text(self.sample_period)} if self.sample_period else {})


@dataclass(frozen=True)
class NewField:
    """The name of a computed field, and what it overrides of its expression's metadata."""

    urn: str
    unit: str | None = None
    kind: str | None = None
    sample_period: int | None = None
    custom: dict[str, Any] | None = None

    def of(self, meta: ValueMeta) -> FieldMeta:
        given = {k: v for k, v in vars(self).items() if k != "urn" and v is not None}
        return meta.but(**given).named(self.urn) if not isinstance(meta, FieldMeta) else meta.value.but(**given).named(self.urn)


def distinct_urns(fields: list[FieldMeta]) -> list[FieldMeta]:
    seen: set[str] = set()
    for f in fields:
        if f.urn in seen:
            raise QueryError(f"duplicate urn {f.urn!r}")
        seen.add(f.urn)
    return fields


def merged(first: dict, *others: dict) -> dict:
    """Custom metadata of several operands; the first one wins."""
    out: dict = {}
    for one in reversed((first, *others)):
        out |= one
    return out


_UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def duration_us(text: str) -> int:
    """Microseconds of a duration such as ``1h30m``, ``5m`` or ``250ms``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise QueryError(f"invalid duration {text!r}")
    total = round(sum(float(n) * _UNITS[u] for n, u in parts))
    return -total if text.startswith("-") else total


def duration_text(us: int) -> str:
    out = []
    for name in ("h", "m", "s", "ms", "us"):
        n, us = divmod(us, round(_UNITS[name]))
        if n:
            out.append(f"{n}{name}")
    return "".join(out) or "0s"
