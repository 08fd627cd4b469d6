"""Expressions, reports, aggregations and their checks."""

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pytest

from tidewheel.functions import expressions as E
from tidewheel.functions.periods import FixedPeriod
from tidewheel.meta import FieldMeta, NewField, QueryError
from tidewheel.operators import aggregation as A
from tidewheel.operators import report as R
from tidewheel.operators import series as S

T0 = datetime(2025, 1, 1, tzinfo=UTC)
D, I, X = (lambda v: E.Constant(v, "decimal")), (lambda v: E.Constant(v, "integer")), E.Ref


def report(fields: dict, rows: list, **optional) -> R.StaticReport:
    """``fields``: name to type; ``rows``: lists of values, a minute apart, or (seconds, values)."""
    metas = tuple(FieldMeta(t, not optional.get(u, False), urn=u) for u, t in fields.items())
    return R.StaticReport(metas, [(T0 + timedelta(seconds=r[0] if isinstance(r, tuple) else 60 * k), r[1] if isinstance(r, tuple) else r) for k, r in enumerate(rows)])


def values(spark, source, *filters):
    found = R.FilteredReport(source, filters).run(spark)
    return [tuple(r)[2:] for r in found.df.select("ts", "seq", *found.names).orderBy("ts", "seq").collect()]


def value(spark, expr, fields=None, row=None, **optional):
    fields = fields or {"a": "integer"}
    return values(spark, report(fields, [row or [1]], **optional), R.SingleField(expr, NewField("v")))[0][0]


@pytest.mark.parametrize(("op", "a", "b", "out"), [("+", 7, 2, 9), ("-", 7, 2, 5), ("*", 7, 2, 14), ("/", 7, 2, 3), ("/", -7, 2, -3), ("%", -7, 2, -1), ("^", 7, 2, 49)])
def test_integer_arithmetic(spark, op, a, b, out):
    assert value(spark, E.Numeric(I(a), op, I(b))) == out


def test_decimal_arithmetic(spark):
    assert value(spark, E.Numeric(I(7), "/", D(2))) == 3.5
    assert value(spark, E.Numeric(D(2), "^", D(0.5))) == pytest.approx(2**0.5)
    for a, b in ((I(1), I(0)), (D(1), D(0))):
        with pytest.raises(Exception, match="division by zero"):
            value(spark, E.Numeric(a, "/", b))
    with pytest.raises(QueryError):
        value(spark, E.Numeric(D(1), "%", D(2)))
    with pytest.raises(QueryError):
        value(spark, E.Numeric(E.Constant("a", "string"), "+", I(2)))


@pytest.mark.parametrize(("op", "a", "out"), [("ceil", -2.5, -2), ("floor", -2.5, -3), ("round", 2.5, 3), ("round", -2.5, -3), ("abs", -2.5, 2.5), ("negate", 1.5, -1.5), ("log", 0.0, float("-inf"))])
def test_unary(spark, op, a, out):
    assert value(spark, E.Unary(D(a), op)) == out


def test_unary_integers(spark):
    assert value(spark, E.Unary(I(17), "sqrt")) == 4
    assert str(value(spark, E.Unary(D(-1.0), "log"))) == "nan"
    with pytest.raises(QueryError):
        value(spark, E.Unary(I(1), "ceil"))


@pytest.mark.parametrize(("number", "text"), [(100.0, "100"), (0.5, "0.5"), (1e10, "10000000000"), (-1.25e-7, "-0.000000125"), (123456789012.75, "123456789012.75"), (1.5e22, "15000000000000000000000")])
def test_decimal_text(spark, number, text):
    assert value(spark, E.Cast(D(number), "string")) == text


def test_casts(spark):
    assert value(spark, E.Cast(D(-2.9), "integer")) == -2
    assert value(spark, E.Cast(E.Constant("12", "string"), "integer")) == 12
    with pytest.raises(Exception, match="no integer"):
        value(spark, E.Cast(E.Constant("1x", "string"), "integer"))
    with pytest.raises(QueryError):
        value(spark, E.Cast(E.Constant(True, "boolean"), "integer"))


def test_constants(spark):
    assert value(spark, E.Constant("t", "boolean")) is True
    for wrong in (("x", "integer"), ("maybe", "boolean"), ("noon", "timestamp"), (None, "integer")):
        with pytest.raises(QueryError):
            value(spark, E.Constant(*wrong))
    with pytest.raises(QueryError):
        value(spark, E.Constant(1, "number"))


def test_conditions_with_nulls_are_false(spark):
    fields, row = {"a": "decimal", "b": "decimal"}, [None, 2.0]
    for op in E.COMPARISONS:
        assert value(spark, E.Condition(op, X("a"), X("b")), fields, row, a=True) is False
    assert value(spark, E.Condition("less_than", I(1), D(1.5))) is True
    nan = E.Unary(D(-1.0), "log")
    assert value(spark, E.Condition("equals", nan, nan)) is False
    for wrong in (E.Condition("less_than", E.Constant("a", "string"), E.Constant("b", "string")), E.Condition("equals", E.Constant("a", "string"), I(1))):
        with pytest.raises(QueryError):
            value(spark, wrong)


def test_selector_is_lazy_and_checked(spark):
    yes = E.Condition("equals", I(1), I(1))
    assert value(spark, E.Selector(yes, I(5), E.Numeric(X("a"), "/", E.Numeric(X("a"), "-", X("a"))))) == 5
    for wrong in (E.Selector(I(1), I(1), I(2)), E.Selector(yes, I(1), D(2)), E.Selector(yes, I(1), E.Nil("integer")), E.Selector(yes, E.Constant(1, "integer", unit="W"), I(2))):
        with pytest.raises(QueryError):
            value(spark, wrong)


def test_logical_and_nvl(spark):
    yes, no = E.Constant(True, "boolean"), E.Constant(False, "boolean")
    assert value(spark, E.Logical("and", yes, no)) is False
    assert value(spark, E.Logical("or", yes, no)) is True
    assert value(spark, E.Nvl(E.Nil("integer"), I(3))) == 3
    for wrong in (E.Logical("and", yes, I(1)), E.Logical("xor", yes, no), E.Nvl(E.Nil("integer"), D(3)), E.Nvl(I(1), E.Nil("integer"))):
        with pytest.raises(QueryError):
            value(spark, wrong)


def test_timestamp_parts(spark):
    at = E.Constant("2024-12-29T23:30:00+00:00", "timestamp")
    part = lambda p, zone="Europe/Berlin": value(spark, E.TimestampExtract(at, p, zone))
    assert [part(p) for p in ("year", "quarter", "month", "dayOfYear", "dayOfMonth", "dayOfWeek", "hour", "minute")] == [2024, 4, 12, 365, 30, 1, 0, 30]
    assert part("epochMillis") == 1735515000000
    with pytest.raises(QueryError):
        part("second")
    with pytest.raises(QueryError):
        value(spark, E.TimestampExtract(I(1), "year"))


def test_unit_and_kind_of_expressions(spark):
    a, b = (FieldMeta("decimal", unit=u, kind=k, urn=n) for n, u, k in (("a", "W", "rate"), ("b", "V", None)))
    found = R.FilteredReport(R.StaticReport((a, b), []), (R.AppendField(E.Numeric(X("a"), "*", X("b")), NewField("c")), R.AppendField(E.Numeric(X("a"), "+", X("a")), NewField("d", custom={"k": 1})))).run(spark)
    assert [(m.unit, m.kind, m.custom) for m in found.metas[2:]] == [("", "rate", {}), ("W", "rate", {"k": 1})]


def test_report_filters(spark):
    given = report({"a": "integer", "b": "integer"}, [[1, 2], [3, 4]])
    assert values(spark, given, R.AppendField(E.ReduceFields("sum"), NewField("c"))) == [(1, 2, 3), (3, 4, 7)]
    assert values(spark, given, R.DropFields(("a",))) == [(2,), (4,)]
    assert values(spark, given, R.ReplaceField("a", I(9), NewField("z"))) == [(9, 2), (9, 4)]
    chained = R.SelectFields(((X("b"), NewField("b")), (E.Numeric(X("b"), "+", I(1)), NewField("n")), (E.Numeric(X("n"), "*", I(2)), NewField("m"))))
    assert values(spark, given, chained) == [(2, 3, 6), (4, 5, 10)]
    assert values(spark, given, R.ReportCondition(E.Condition("greater_than", X("a"), I(1)))) == [(3, 4)]
    for wrong in (R.DropFields(("a", "b")), R.DropFields(("z",)), R.AppendField(I(1), NewField("a")), R.OverrideFieldMeta("a", urn="b"), R.OverrideFieldMeta("z"), R.ReplaceField("z", I(1), NewField("a")), R.SingleField(X("z"), NewField("v")), R.ReportCondition(I(1))):
        with pytest.raises(QueryError):
            values(spark, given, wrong)
    assert R.OverrideFieldMeta("a", unit="W").apply(given.run(spark)).metas[0].custom == {}


def test_duplicate_names(spark):
    with pytest.raises(QueryError):
        R.StaticReport((FieldMeta("integer", urn="a"), FieldMeta("integer", urn="a")), []).run(spark)
    with pytest.raises(QueryError):
        R.StaticReport((), []).run(spark)
    a = report({"a": "integer"}, [[1]])
    with pytest.raises(QueryError):
        R.JoinReports(R.ListReports((a, a))).run(spark)


def test_odd_names(spark):
    found = report({"My:field.x `y`": "integer"}, [[1]]).run(spark).result()
    assert found.columns == ["ts", "My:field.x `y`"]
    assert found.first()[1] == 1


def test_joins(spark):
    a = report({"a": "integer"}, [(0, [1]), (0, [2]), (60, [3]), (180, [4])])
    b = report({"b": "integer"}, [(0, [10]), (60, [30]), (60, [31]), (120, [50])])
    c = report({"c": "integer"}, [(0, [100]), (60, [300])])
    run = lambda kind, *parts: [tuple(v) for v in values(spark, R.JoinReports(R.ListReports(parts), kind))]
    assert run("inner", a, b) == [(1, 10), (3, 30)]
    assert run("left", a, b) == [(1, 10), (2, 10), (3, 30), (4, None)]
    assert run("full", a, b) == [(1, 10), (2, None), (3, 30), (None, 31), (None, 50), (4, None)]
    assert run("inner", a, b, c) == [(1, 10, 100), (3, 30, 300)]
    found = R.JoinReports(R.ListReports((a, b)), "left").run(spark)
    assert [m.required for m in found.metas] == [True, False]
    with pytest.raises(QueryError):
        run("outer", a, b)


def test_struct_report(spark):
    @dataclass
    class Reading:
        when: datetime
        power: float
        site: str

    found = R.struct_report(Reading, [Reading(T0, 1.5, "x")]).run(spark)
    assert [m.urn for m in found.metas] == ["Reading:power", "Reading:site"]
    assert not any(m.required for m in found.metas)

    @dataclass
    class Bad:
        power: float

    with pytest.raises(QueryError):
        R.struct_report(Bad, [])


def test_report_aligner_overrides(spark):
    given = report({"a": "decimal", "b": "decimal"}, [(0, [1.0, 1.0]), (30, [3.0, 5.0]), (180, [8.0, 2.0])])
    minute = FixedPeriod(60_000_000)
    one = R.ReportAligner(minute, "linear", {"b": R.FieldAlignment("max", "forwardFill")})
    assert values(spark, given, one) == [(1, 5), (pytest.approx(1 + 7 / 3), 5), (pytest.approx(1 + 14 / 3), 5), (8, 2)]
    for wrong in (R.ReportAligner(minute, None, {"z": R.FieldAlignment("max")}), R.ReportAligner(minute, None, {"b": R.FieldAlignment("mae")}), R.ReportAligner(minute, None, {"b": R.FieldAlignment("max", "linear")})):
        with pytest.raises(QueryError):
            values(spark, given, wrong)
    with pytest.raises(QueryError):
        values(spark, report({"a": "string"}, [["x"]]), R.ReportAligner(minute))


def test_field_order():
    a, b, c = (X("b"), NewField("a")), (X("c"), NewField("b")), (X("outside"), NewField("c"))
    assert [n.urn for _, n in R.ordered_fields([a, b, c])] == ["c", "b", "a"]
    with pytest.raises(QueryError):
        R.ordered_fields([a, (X("a"), NewField("b"))])


def scalars(spark, source, *fields):
    found = A.FromReport(source, tuple(A.AggregatedField(r, NewField(f"{r}{k}"), empty, s, other) for k, (r, s, other, empty) in enumerate(fields))).run(spark)
    return list(found.df.select(*[f"v{k}" for k in range(len(fields))]).first())


def test_paired_reductions(spark):
    given = report({"a": "decimal", "p": "decimal"}, [[1.0, 2.0], [2.0, 2.0], [4.0, 3.0], [0.0, 1.0], [None, 5.0]], a=True)
    names = ("mae", "rmse", "mbe", "mape", "pearson", "r2")
    found = scalars(spark, given, *[(n, "a", "p", None) for n in names])
    a, p = [1, 2, 4, 0], [2, 2, 3, 1]
    mean = sum(a) / 4
    ss = sum((x - y) ** 2 for x, y in zip(a, p, strict=True))
    assert found[0] == pytest.approx(0.75)
    assert found[1] == pytest.approx((ss / 4) ** 0.5)
    assert found[2] == pytest.approx(-0.25)
    assert found[3] == pytest.approx(100 * (1 + 0 + 0.25) / 3)
    assert found[4] == pytest.approx(0.956, abs=1e-3)
    assert found[5] == pytest.approx(1 - ss / sum((x - mean) ** 2 for x in a))
    constant = report({"a": "decimal", "p": "decimal"}, [[1.0, 2.0], [1.0, 3.0]])
    assert scalars(spark, constant, ("pearson", "a", "p", None), ("r2", "a", "p", None)) == [None, None]


def test_aggregation_details(spark):
    given = S.StaticSeries(FieldMeta("decimal", urn="x", unit="W"), [(T0 + timedelta(seconds=k), v) for k, v in enumerate([2.0, 5.0, 1.0, 5.0, 1.0])])
    names = ("min", "max", "first", "last", "count", "p95")
    found = A.FromSeries(given, tuple(map(A.AggregatedField, names))).run(spark)
    assert [m.urn for m in found.metas] == [f"x_{n}" for n in names]
    assert [m.unit for m in found.metas] == ["W", "W", "W", "W", "", "W"]
    row = found.df.first()
    assert [row[f"v{k}"] for k in range(6)] == [1, 5, 2, 1, 5, 5]
    assert [row[f"t{k}"] and row[f"t{k}"].second for k in range(6)] == [2, 1, 0, 4, None, None]
    none = S.StaticSeries(FieldMeta("decimal", urn="x"), [])
    row = A.FromSeries(none, (A.AggregatedField("sum"), A.AggregatedField("count"), A.AggregatedField("avg", empty=D(7)))).run(spark).df.first()
    assert [row[f"v{k}"] for k in range(3)] == [None, 0, 7]


def test_aggregation_errors(spark):
    given = report({"a": "decimal", "s": "string"}, [[1.0, "x"]])
    for wrong in (("mae", "a", None, None), ("sum", "a", "a", None), ("sum", "z", None, None), ("mae", "a", "z", None), ("sum", "s", None, None), ("median", "a", None, None)):
        with pytest.raises(QueryError):
            scalars(spark, given, wrong)
    one = A.FromReport(given, (A.AggregatedField("sum", NewField("v"), None, "a"),))
    with pytest.raises(QueryError):
        A.Composite((one, A.FromReport(given, (A.AggregatedField("avg", NewField("v"), None, "a"),)))).run(spark)
    both = A.Composite((one, A.FromReport(given, (A.AggregatedField("avg", NewField("w"), None, "a"),))))
    assert len(both._merged()) == 1
    assert both.run(spark).result().first()["w"] == 1
