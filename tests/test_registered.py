"""Registered queries against their SQL, and what holds of all of them."""

import math
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from tidewheel import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "-"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.5f}"
        return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)

    cols = sorted(df.columns)
    return cols, sorted([[one(v) for v in r] for r in df[cols].astype(object).itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_against_sql(spark, db, name):
    got, want = plain(engine.QUERIES[name](spark, SF).toPandas()), plain(db.execute(engine.ORACLES[name]).df())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_range_reaches_the_scan(spark):
    from datetime import datetime

    plan = engine.events(SF).run(spark, datetime(2024, 1, 2), datetime(2024, 1, 3)).df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan or "GreaterThanOrEqual(ts" in plan.split("PushedFilters", 1)[-1]


COUNTERS = ["delta_plain", "delta_counter_reset", "delta_counter_emit", "delta_counter_wrap", "rate_per_hour"]


@pytest.mark.parametrize("name", COUNTERS)
def test_counters_take_every_event(spark, db, name):
    """A row for each event but the first, whoever its user is."""
    n = db.execute("SELECT count(*) FROM events").fetchone()[0]
    assert engine.QUERIES[name](spark, SF).count() == n - 1
    assert name in engine.ORACLES


def test_gaps_of_every_event(spark, db):
    n = db.execute("SELECT count(*) FROM (SELECT ts - lag(ts) OVER (ORDER BY ts) AS gap FROM events) WHERE gap <= INTERVAL '20 minutes'").fetchone()[0]
    assert engine.QUERIES["delta_gap"](spark, SF).count() == n > 0


def negative_gap(rows: list) -> list:
    """(ts, value) of the readings in order of time, one by one; ``rows``: (ts, event_id, value)."""
    out, base = [], None
    for ts, _, value in sorted(rows):
        v = math.floor(value * 10 + 0.5) - 60
        late = base is not None and ts - base[0] > timedelta(days=1)
        if base is not None and not late and v >= 0:
            out.append((ts, max(v - base[1], 0)))
        if base is None or late or v >= 0:
            base = ts, v
    return out


def test_negative_gap_takes_every_event(spark, db, tmp_path):
    run = engine.QUERIES["delta_counter_negative_gap"]
    rows = db.execute("SELECT ts, event_id, value FROM events").fetchall()
    got = [(r["ts"], r["value"]) for r in run(spark, SF).orderBy("ts").collect()]
    assert got == negative_gap(rows)
    assert sum(v < 6 for _, _, v in rows) > 20
    # gaps of hours to two days, users of any id, below zero first and for long
    hours, values = (0, 1, 20, 26, 27, 52, 70, 71, 96, 121, 122, 170, 171, 180, 204, 205, 206), (1, 0, 9, 0, 2, 1, 30, 0, 0, 1, 20, 2, 40, 7, 0, 8, 50)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=h), k, float(v)) for k, (h, v) in enumerate(zip(hours, values, strict=True))]
    frame = spark.createDataFrame([(*r, 1000 + r[1]) for r in rows], "ts timestamp_ntz, event_id long, value double, user_id long")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    assert [(r["ts"], r["value"]) for r in run(spark, str(tmp_path)).orderBy("ts").collect()] == negative_gap(rows)


@pytest.mark.parametrize(("name", "size", "step"), [("count_window_3_1", 3, 1), ("count_window_5_3", 5, 3)])
def test_windows_take_every_event(spark, db, name, size, step):
    ids = [i for (i,) in db.execute("SELECT event_id FROM events ORDER BY event_id").fetchall()]
    want = [(k, size, sum(ids[k : k + size])) for k in range(0, len(ids) - size + 1, step)]
    after = len(want) * step
    if step > 1 and after < len(ids):
        want.append((after, len(ids) - after, sum(ids[after:])))
    assert [tuple(r) for r in engine.QUERIES[name](spark, SF).select("start", "n", "total").orderBy("start").collect()] == want


def test_time_shift_takes_every_event(spark, db):
    want = [(ts + timedelta(days=1), v) for ts, v in db.execute("SELECT ts, value FROM events ORDER BY ts").fetchall()]
    assert [(r["ts"], r["value"]) for r in engine.QUERIES["time_shift"](spark, SF).orderBy("ts").collect()] == want


@pytest.mark.parametrize("name", ["rate_per_hour", "json_rate"])
def test_rates_over_no_time(spark, tmp_path, name):
    """Events that share their times, one of them with no value: the SQL divides by no time, which is infinite or no number."""
    times = (0, 0, 0, 5, 5, 24 * 60, 24 * 60, 24 * 60 + 1)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=m), k, float(v)) for k, (m, v) in enumerate(zip(times, (1, 2, 0, 3, 4, 1, 9, 0), strict=True))]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = [(t, str(abs(v)) if v != v else v) for t, v in c.execute(engine.ORACLES[name]).fetchall()]
    got = [(r["ts"], str(r["value"]) if r["value"] != r["value"] else r["value"]) for r in engine.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {v for _, v in got} >= {math.inf, "nan", 0.0}


def test_small_pieces_are_written_together():
    """A call to the JVM for each line took most of the time of the queries that write a file and read it again."""
    from unittest.mock import MagicMock

    spark = MagicMock()
    spark.conf.get.return_value = "file:/nowhere"
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path.return_value.getFileSystem.return_value.create.return_value
    rows = [f"line {k} ß\n" for k in range(300_000)]
    engine._written(spark, "lines", lambda write: [write(r) for r in rows])
    assert b"".join(bytes(c.args[0]) for c in out.write.call_args_list).decode() == "".join(rows)
    assert 1 < out.write.call_count < 20 and max(len(c.args[0]) for c in out.write.call_args_list) < 2 << 20
    assert out.close.call_count == 1
    out.write.reset_mock()
    engine._written(spark, "lines", lambda write: None)
    assert out.write.call_count == 0
