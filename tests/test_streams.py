"""Ordered rows, sources, JSON queries and streaming."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewheel.meta import QueryError
from tidewheel.operators import streams as L
from tidewheel.plans.parse import Parser, Plugins, execute_aggregation, execute_query, scalars_json, series_json
from tidewheel.sources import readers
from tidewheel.streaming import series as X


def ints(spark, values):
    return readers.rows(spark, values, "v long")


def windows(rows, size, step, omit):
    out, at = [], 0
    while at + size <= len(rows):
        out.append(rows[at : at + size])
        at += step
    if not omit and step != 1 and at < len(rows):
        out.append(rows[at:])
    return out


@pytest.mark.parametrize("n", [0, 2, 5, 7])
@pytest.mark.parametrize(("size", "step"), [(3, 1), (5, 3), (2, 2)])
@pytest.mark.parametrize("omit", [False, True])
def test_count_windows(spark, n, size, step, omit):
    df = spark.range(n).select("id")
    found = L.count_windows(df, size, step, "id", "id", omit).orderBy("start").collect()
    assert [r["items"] for r in found] == windows(list(range(n)), size, step, omit)


def test_window_errors(spark):
    for size, step in ((2, 3), (2, 0)):
        with pytest.raises(QueryError):
            L.count_windows(spark.range(3), size, step, "id", "id")


def test_paging_and_sampling(spark):
    df = spark.range(10)
    ids = lambda d: [r[0] for r in d.collect()]
    assert ids(L.page(df, 1, 4, "id")) == [4, 5, 6, 7]
    assert ids(L.page(df, 2, 4, "id")) == [8, 9]
    assert ids(L.page(df, -1, 4, "id")) == ids(L.page(df, 0, 0, "id")) == ids(L.limited(df, -1, "id")) == []
    assert ids(L.skipped(df, 8, "id")) == [8, 9]
    assert len(set(ids(L.sampled(df, 4)))) == 4
    assert len(ids(L.sampled(df, 40))) == 10


def test_merge_zip_concat(spark):
    a, b = ints(spark, [1, 3, 3]), ints(spark, [2, 3, 9, 10])
    assert [(r["v"], r["src"]) for r in L.merged_sorted("v", "seq", a, b).collect()] == [(1, 0), (2, 1), (3, 0), (3, 0), (3, 1), (9, 1), (10, 1)]
    assert [(r["s0"]["v"], r["s1"]["v"]) for r in L.zipped("seq", a, b).orderBy("pos").collect()] == [(1, 2), (3, 3), (3, 9)]
    assert L.concatenated(a, b).count() == 7


def test_joins(spark):
    a, b = ints(spark, [1, 2, 2, 4]), readers.rows(spark, [(2, "x"), (2, "y"), (4, "z"), (5, "w")], "v long, t string")
    got = lambda how: sorted((r["v"], r["l"]["seq"], r["r"] and r["r"]["t"]) for r in L.join_sorted(a, b, "v", "seq", how).collect())
    assert got("inner") == [(2, 1, "x"), (2, 2, "x"), (4, 3, "z")]
    assert got("left") == [(1, 0, None), (2, 1, "x"), (2, 2, "x"), (4, 3, "z")]
    many = sorted((r["v"], r["dup"], r["s0"]["seq"], r["s1"]["t"]) for r in L.join_many("v", "seq", a, b).collect())
    assert many == [(2, 1, 1, "x"), (2, 2, 2, "y"), (4, 1, 3, "z")]
    assert L.join_many("v", "seq", a, b, how="full").count() == 5
    with pytest.raises(QueryError):
        L.join_sorted(a, b, "v", "seq", "full")


def test_order_check(spark):
    assert L.checked_order(ints(spark, [1, 2, 2, 3]), "v", "seq").count() == 4
    with pytest.raises(Exception, match="out of order"):
        L.checked_order(ints(spark, [1, 3, 2]), "v", "seq").collect()


def test_collectors(spark):
    df = ints(spark, [5, 6, 5])
    assert {r["v"]: r["n"] for r in L.counted_by(df, "v").collect()} == {5: 2, 6: 1}
    assert {r["v"]: r["seq"] for r in L.last_by_key(df, "v", ["seq"]).collect()} == {5: 2, 6: 1}
    with pytest.raises(Exception, match="duplicate key"):
        L.unique_by_key(df, "v").collect()
    ends = L.first_and_last(df, ["seq"]).first()
    assert (ends["first"]["v"], ends["last"]["v"]) == (5, 5)
    seen, text = [], []
    assert L.consume(df, lambda r: seen.append(r["v"]), "seq") == 3
    assert seen == [5, 6, 5]
    assert L.write_json_array(df.select("v", "seq"), text.append, "seq") == 3
    assert [r["v"] for r in json.loads("".join(text))] == seen
    text.clear()
    L.write_json_array(df.limit(0), text.append)
    assert "".join(text) == "[]"
    assert [(k, r["v"]) for k, r in L.indexed(df, "seq")] == [(0, 5), (1, 6), (2, 5)]
    assert [r["value"] for r in L.folded(df, "seq", "v", F.lit(0).cast("long"), lambda s, x: s * 10 + x).collect()] == [565]


def test_maps_and_json_chunks(spark):
    df = ints(spark, [5, 6, 7])
    assert L.as_map(df, "v", "seq").first()["map"] == {5: 0, 6: 1, 7: 2}
    with pytest.raises(Exception, match="duplicate key"):
        L.as_map(ints(spark, [5, 5]), "v", "seq").collect()
    for rows in (1, 2, 3, 9):
        assert [r["v"] for r in json.loads("".join(L.json_chunks(df, "seq", rows=rows)))] == [5, 6, 7]
    assert "".join(L.json_chunks(df.limit(0))) == "[]"


def test_python_sources(spark):
    def part_rows(part):
        return [(part * 10 + k, f"r{k}") for k in range(3)]

    def messages(offset):
        return iter([(k, json.dumps({"x": k * k})) for k in range(offset, 7)])

    got = readers.from_function(spark, part_rows, "n long, t string", 2).orderBy("n").collect()
    assert [r["n"] for r in got] == [0, 1, 2, 10, 11, 12]
    stream = X.json_messages(X.message_stream(spark, messages, 3), "x long")
    q = stream.writeStream.format("memory").queryName("squares").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["x"] for r in spark.table("squares").collect()) == [k * k for k in range(7)]


def test_clusters(spark):
    found = L.clustered(ints(spark, range(10)), F.floor(F.col("v") / 4), ["seq"], [F.sum("v").alias("s")]).orderBy("cluster").collect()
    assert [(r["cluster"], r["s"], r["prev"] and r["prev"]["v"]) for r in found] == [(0, 6, None), (1, 22, 3), (2, 17, 7)]


def test_projection_and_optional(spark):
    df = ints(spark, [1, None, 3])
    assert [r[0] for r in L.mapped(df, (F.col("v") * 2).alias("w"), keep_null=False).collect()] == [2, 6]
    assert L.flattened(spark.createDataFrame([([7, 8],)], "a array<int>"), "a").collect()[1]["value"] == 8
    assert L.mapped_batches(spark.range(4), lambda it: (b * 2 for b in it), "id long", 2).count() == 4
    some, none = L.Optional.of(spark, [4], "int"), L.Optional.of(spark, [], "int")
    assert some.map(lambda c: c + 1).get() == 5
    assert none.or_(some).get() == 4
    assert none.get(9) == 9
    assert none.empty
    assert some.filter(lambda c: c > 4).empty
    with pytest.raises(KeyError):
        none.or_raise(KeyError("x"))
    log = []
    with pytest.raises(ZeroDivisionError), L.hooks(lambda: log.append("first"), lambda e: log.append(type(e).__name__)):
        1 / 0  # noqa: B018
    assert log == ["first", "ZeroDivisionError"]


def test_sources(spark, tmp_path):
    assert readers.empty(spark, "a int").count() == 0
    with pytest.raises(Exception, match="broken"):
        readers.failing(spark, "broken", "a int").collect()
    assert sorted(r[0] for r in readers.from_mapping(spark, {"a": 1, "b": 2}, "string", "int", "keys").collect()) == ["a", "b"]
    path = tmp_path / "lines.txt"
    path.write_text("a\nb\n\nc")
    got = lambda reverse: [r["line"] for r in readers.lines(spark, str(path), reverse).orderBy("seq").collect()]
    assert got(False) == ["a", "b", "", "c"]
    assert got(True) == ["c", "", "b", "a"]
    assert readers.lines(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert [r["x"] for r in readers.json_array(spark, str(tmp_path / "a.json"), "x int").orderBy("seq").collect()] == [1, 2]
    (tmp_path / "o.json").write_text('{"p": 1, "q": 2}')
    assert {r["key"]: r["value"] for r in readers.json_object(spark, str(tmp_path / "o.json"), "int").collect()} == {"p": 1, "q": 2}
    with pytest.raises(Exception, match="no array"):
        readers.json_array(spark, str(tmp_path / "o.json"), "x int").collect()


def series_node(values, **meta):
    data = [{"timestamp": f"2025-01-01T00:{m:02d}:00+00:00", "value": v} for m, v in values.items()]
    return {"type": "static", "fieldMeta": {"uri": "x", "dataType": "decimal", "required": True, **meta}, "data": data}


RANGE = {"from": "2025-01-01T00:00:00+00:00", "to": "2025-01-02T00:00:00+00:00"}


def test_json_query(spark):
    node = {"type": "filtered", "datasource": series_node({0: 1.0, 5: 3.0, 9: 8.0}, metricKind="cumulative", samplePeriod="5m"), "filters": [{"type": "delta", "maxGapDuration": "10m"}, {"type": "timeShift", "offsetSeconds": 60}]}
    found = series_json(execute_query(spark, {"datasource": node, **RANGE}))
    assert [d["value"] for d in found["data"]] == [2, 5]
    assert found["meta"]["metricKind"] == "delta"
    assert found["data"][0]["timestamp"].startswith("2025-01-01T00:06:00")


def test_json_aggregation(spark):
    many = {"type": "list", "datasources": [series_node({0: 1.0, 5: 3.0}), series_node({0: 2.0, 5: 5.0}, uri="y")]}
    report = {"type": "join", "joinType": "full", "multiDatasource": {"type": "fromMultiDatasource", "multiDatasource": many}}
    source = {"type": "fromReport", "reportDatasource": report, "fields": [{"reductionType": "mae", "sourceFieldUrn": "x", "compareFieldUrn": "y", "fieldMeta": {"uri": "e"}}, {"reductionType": "max", "sourceFieldUrn": "x", "fieldMeta": {"uri": "m"}}]}
    with pytest.raises(QueryError):  # a full join makes the fields optional, which a required cast keeps
        execute_aggregation(spark, {"aggregation": {"type": "nothing"}, **RANGE})
    share = {"type": "numericExpression", "op1": {"type": "ref", "urn": "e"}, "op": "/", "op2": {"type": "ref", "urn": "m"}}
    found = scalars_json(execute_aggregation(spark, {"aggregation": {"type": "composite", "aggregations": [source, {"type": "expression", "source": source, "fields": [{"fieldMeta": {"uri": "share"}, "value": share}]}]}, **RANGE}))
    assert [f["value"] for f in found["fields"]] == [1.5, 3.0, 0.5]
    assert found["fields"][1]["timestamp"].startswith("2025-01-01T00:05")


def test_json_errors():
    p = Parser()
    for wrong in ({}, {"type": "x"}, {"type": "static"}, {"type": "filtered", "datasource": series_node({}), "filters": [{"type": "x"}]}, {"type": "static", "fieldMeta": {"uri": "", "dataType": "decimal"}}):
        with pytest.raises(QueryError):
            p.datasource(wrong)
    calendar = lambda **k: {"type": "aligner", "alignerPeriod": {"type": "calendar", "alignmentPeriodType": "day", "zoneId": "UTC", **k}}
    for wrong in (calendar(zoneId="Nowhere"), calendar(alignmentPeriodType="decade"), calendar() | {"fillMode": "nearest"}, {"type": "aligner", "alignerPeriod": {"type": "custom", "durationInMillis": 0, "zoneId": "UTC"}}, {"type": "timeShift", "offsetSeconds": 0}, {"type": "delta", "maxCounterValue": 5}, {"type": "delta", "maxGapDuration": "soon"}):
        with pytest.raises(QueryError):
            p.filter(wrong)


def test_plugins(spark):
    plugins = Plugins()
    plugins.register("filter", "double", lambda parser, n: parser.filter({"type": "fieldValue", "fieldMeta": {"uri": "twice"}, "fieldValue": {"type": "numericExpression", "op1": {"type": "ref"}, "op": "*", "op2": {"type": "constant", "dataType": "decimal", "fieldValue": n["by"]}}}))
    node = {"type": "filtered", "datasource": series_node({0: 1.0}), "filters": [{"type": "double", "by": 2}]}
    assert execute_query(spark, {"datasource": node, **RANGE}, plugins).df.first()["value"] == 2
    with pytest.raises(QueryError):
        plugins.register("aggregation", "x", lambda p, n: None)


def test_stateful_delta_equals_the_fold(spark, tmp_path):
    rows = [(k, datetime(2025, 1, 1, 0, m), v) for k in (1, 2) for m, v in enumerate([3.0, 5.0, -1.0, 2.0, 9.0])]
    for n, part in enumerate((rows[:3] + rows[5:7], rows[3:5] + rows[7:])):
        spark.createDataFrame(part, "k int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = X.read_stream(spark, str(tmp_path / "in"), "k int, ts timestamp, value double", 10)
    found = X.run_to_memory(X.stateful_delta(stream, "k"), "deltas").orderBy("k", "ts").collect()
    assert [(r["k"], r["ts"].minute, r["delta"]) for r in found] == [(k, m, d) for k in (1, 2) for m, d in ((1, 2.0), (3, 0.0), (4, 7.0))]
    with pytest.raises(QueryError):
        X.stateful_delta(stream, "k", reset="none")


def test_folds_of_any_length(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 7), ("a", 3, 6), ("a", 2, 9), (None, 1, 4)], "k string, at long, v long")
    got = {r["k"]: r["value"] for r in L.folded_rows(df, ("k",), ("at",), "v", 0, lambda s, x: s * 10 + x, "long").collect()}
    assert got == {"a": 596, "b": 7, None: 4}
    assert [r["value"] for r in L.folded_rows(df.filter("k = 'a'"), (), ("at",), "v", "", lambda s, x: f"{s}{x}", "string").collect()] == ["596"]
    assert L.folded_rows(df.limit(0), ("k",), ("at",), "v", 0, lambda s, x: s, "long").count() == 0
    long = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id"))
    want = {0: 0, 1: 0}
    for k in range(30_000):
        want[k % 2] = (want[k % 2] * 31 + k) % 1009
    assert {r["k"]: r["value"] for r in L.folded_rows(long, ("k",), ("id",), "id", 0, lambda s, x: (s * 31 + x) % 1009, "long").collect()} == want


def test_pages_and_clusters_by_text(spark):
    words = [f"w{k * 7919 % 1000:03d}" for k in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    assert [r["w"] for r in L.page(df, 3, 10, "w").collect()] == [f"w{k:03d}" for k in range(30, 40)]
    assert [r["w"] for r in L.skipped(df, 995, "w").collect()] == [f"w{k:03d}" for k in range(995, 1000)]
    found = L.clustered(df, F.substring("w", 1, 2), ["w"], [F.count("*").alias("n")]).orderBy("cluster").collect()
    assert [(r["cluster"], r["n"], r["prev"] and r["prev"]["w"]) for r in found] == [(f"w{k}", 100, f"w{k - 1}99" if k else None) for k in range(10)]


def test_more_of_optional_values(spark):
    some, none = L.Optional.of(spark, [4], "long"), L.Optional.of(spark, [], "long")
    assert some.flat_map(lambda v: L.Optional.of(spark, [v * 2], "long")).get() == 8
    assert none.flat_map(lambda v: some).empty
    seen = []
    assert some.consume(seen.append) and not none.consume(seen.append) and seen == [4]
    assert (some.or_else_get(lambda: 1 / 0), none.or_else_get(lambda: 5)) == (4, 5)
    assert (some.as_json(), none.as_json()) == ("4", "null")
    assert L.Optional.from_json(spark, '{"a": 1}', "struct<a:int>").get()["a"] == 1
    assert L.Optional.from_json(spark, "null", "long").empty
    with pytest.raises(Exception):  # noqa: B017  malformed
        L.Optional.from_json(spark, "{", "struct<a:int>").get()


def test_writers_and_responses(spark):
    df, text, started = ints(spark, [5, 6, 7]).select("v"), [], []

    def init():
        started.append(len(text))
        return text.append

    assert L.write_json_array_with(df, init, "v") == 3
    assert json.loads("".join(text)) == [{"v": 5}, {"v": 6}, {"v": 7}] and started == [0]
    text.clear()
    assert L.write_json_array_with(df.limit(0), init) == 0 and text == ["[", "]"]
    with pytest.raises(Exception, match="boom"):
        L.write_json_array_with(readers.failing(spark, "boom", "v long"), init)
    assert len(started) == 2
    calls = []
    body = b"".join(L.json_response(df, "v")({}, lambda status, headers: calls.append((status, headers))))
    assert json.loads(body) == [{"v": 5}, {"v": 6}, {"v": 7}]
    assert calls == [("200 OK", [("Content-Type", "application/json")])]


def test_buffers_and_locks():
    import threading

    assert list(L.buffered(iter(range(50)), 3)) == list(range(50))
    assert list(L.buffered([], 1)) == []

    def bad():
        yield 1
        raise KeyError("later")

    rows = L.buffered(bad(), 4)
    assert next(rows) == 1
    with pytest.raises(KeyError):
        next(rows)
    with pytest.raises(QueryError):
        list(L.buffered([1], 0))
    read = []

    def endless():
        for k in range(10**9):
            read.append(k)
            yield k

    some = L.buffered(endless(), 2)
    assert next(some) == 0
    some.close()
    lock = threading.Lock()
    with L.locked(lock):
        assert lock.locked()
    assert not lock.locked()


def test_queries_on_a_database(spark):
    """An embedded database, whole and dealt out by a column."""
    url = "jdbc:derby:memory:tidewheel;create=true"
    rows = [(k, f"name {k}", datetime(2024, 1, 1, 0, k % 60)) for k in range(100)]
    spark.createDataFrame(rows, "ID long, NAME string, MADE timestamp").write.mode("overwrite").jdbc(url, "MY_TABLE")
    got = readers.query(spark, url, "SELECT ID, NAME, MADE FROM MY_TABLE WHERE ID >= 90")
    assert [(r["ID"], r["NAME"], r["MADE"]) for r in got.orderBy("ID").collect()] == rows[90:]
    assert readers.query(spark, url, "SELECT ID FROM MY_TABLE WHERE ID < 0").count() == 0
    with pytest.raises(Exception):  # noqa: B017  no such table
        readers.query(spark, url, "SELECT * FROM NOTHING").collect()


def test_approximate_percentiles_from_json(spark):
    data = [{"timestamp": f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}+00:00", "value": float(k)} for k in range(1000)]
    static = {"type": "static", "fieldMeta": {"uri": "x", "dataType": "decimal", "required": True}, "data": data}
    fields = [{"reductionType": "p90", "fieldMeta": {"uri": "near"}, "approximate": True}, {"reductionType": "p90", "fieldMeta": {"uri": "exact"}}]
    row = execute_aggregation(spark, {"from": "2024-01-01T00:00:00+00:00", "to": "2025-01-01T00:00:00+00:00", "aggregation": {"type": "fromDatasource", "datasource": static, "fields": fields}}).result().first()
    assert row["exact"] == pytest.approx(899.1)
    assert abs(row["near"] - 899.1) < 2


@pytest.mark.parametrize("per_line", [1, 2, 3])
def test_json_files_are_read_by_lines(spark, tmp_path, monkeypatch, per_line):
    """Pretty-printed, packed, and with brackets, commas and quotes in strings."""
    monkeypatch.setattr(readers, "_LINES", per_line)
    rows = [{"a": k, "s": ["x, ]", 'q"uo\\te', "{[", "", "line\nend"][k % 5], "n": {"m": [[k], []], "e": {}}} for k in range(23)]
    texts = [json.dumps(rows), json.dumps(rows, indent=2), "[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n", " [ " + " , ".join(map(json.dumps, rows)) + " ] "]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(text)
        got = readers.json_array(spark, str(tmp_path / f"{k}.json"), "a long, s string, n struct<m:array<array<long>>>").orderBy("seq").collect()
        assert [(r["seq"], r["a"], r["s"], r["n"]["m"]) for r in got] == [(j, r["a"], r["s"], r["n"]["m"]) for j, r in enumerate(rows)]
        (tmp_path / f"o{k}.json").write_text(json.dumps({r["s"] + str(r["a"]): r["a"] for r in rows}, indent=k or None))
        assert {r["key"]: r["value"] for r in readers.json_object(spark, str(tmp_path / f"o{k}.json"), "long").collect()} == {r["s"] + str(r["a"]): r["a"] for r in rows}
    for name, text in (("e", "[]"), ("f", "[\n\n]"), ("g", "")):
        (tmp_path / name).write_text(text)
        assert readers.json_array(spark, str(tmp_path / name), "a long").count() == 0
    for name, text in (("x", '{"a": 1}'), ("y", '"text"'), ("z", '[1]\n"more"')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="no array"):
            readers.json_array(spark, str(tmp_path / name), "a long").collect()


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from tidewheel import shared

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master, environment = "spark://host:7077", {}

        def getConf(self):  # noqa: N802  Spark's name
            return Conf()

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class Option:
                            @staticmethod
                            def isDefined():  # noqa: N802
                                return False

                        return Option()

                return S()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_root(Session())
    Context.master = "local[4]"
    assert shared.shared_root(Session()).startswith("file:///")
