"""Series that never end: tumbling alignment with a watermark, and stateful deltas.

A watermark says how late a row may be; later ones are dropped. A bucket is emitted when the watermark
has passed its end, so the last one stays open until a later row arrives.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.reductions import over_rows
from ..meta import QueryError
from ..sources.readers import packed, unpacked


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as they appear."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def json_messages(messages: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of a stream of JSON texts (Kafka, sockets): (columns of the schema)."""
    return messages.select(F.from_json(F.col(column).cast("string"), schema).alias("m")).select("m.*")


class MessageSource(DataSource):
    """Messages of an endless generator, a text a row: option ``function`` holds what yields (offset, text) from an offset on, pickled."""

    @classmethod
    def name(cls) -> str:
        return "tidewheel_messages"

    def schema(self) -> str:
        return "offset long, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802  Spark's name
        return _MessageReader(self.options["function"], int(self.options.get("batch", "1000")))


class _MessageReader(SimpleDataSourceStreamReader):
    def __init__(self, function: str, batch: int):
        self.function, self.batch = function, batch

    def _from(self, offset: int) -> Iterator[tuple[int, str]]:
        return unpacked(self.function)(offset)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(itertools.islice(self._from(start["offset"]), self.batch))
        return iter(rows), {"offset": rows[-1][0] + 1 if rows else start["offset"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return itertools.takewhile(lambda row: row[0] < end["offset"], self._from(start["offset"]))


def message_stream(spark: SparkSession, fn, batch: int = 1000) -> DataFrame:
    """(offset, value) of a function that yields (offset, text) from an offset on: a websocket, a queue, a log."""
    spark.dataSource.register(MessageSource)
    return spark.readStream.format("tidewheel_messages").option("function", packed(fn)).option("batch", str(batch)).load()


def tumbling(stream: DataFrame, reductions: dict[str, str], every: str, late: str, ts: str = "ts", value: str = "value", keys: tuple[str, ...] = (), data_type: str = "decimal") -> DataFrame:
    """Buckets of ``every``, each with its reductions (output name to reduction)."""
    order = F.struct(ts)
    for name in reductions.values():
        if name in ("first", "last"):
            continue
        if name.startswith("p") and name[1:].isdigit():
            raise QueryError("percentiles of a stream need approx=True on a batch of it")
    aggs = [over_rows(r, F.col(value), order, data_type).alias(n) for n, r in reductions.items()]
    found = stream.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(*aggs)
    return found.select(F.col("window.start").alias("ts"), *keys, *reductions)


def stateful_delta(stream: DataFrame, key: str, ts: str = "ts", value: str = "value", reset: str = "zero", max_gap_us: int | None = None) -> DataFrame:
    """(key, ts, delta) of counters by key: the state of a key is its last reading.

    ``reset``: what a decrease gives, zero or the reading (``emit``). A negative reading is dropped, and
    leaves the state as it is unless it is the first one or follows a gap. Rows of a batch are taken in
    order of time; one older than the state is dropped.
    """
    if reset not in ("zero", "emit"):
        raise QueryError(f"unknown reset {reset!r}")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        at, was = state.get if state.exists else (None, None)
        rows, out = pd.concat(list(batches)).sort_values("us", kind="stable"), []
        for us, v in zip(rows["us"], rows["v"], strict=True):
            us = int(us)
            if at is not None and us < at:
                continue
            if at is None or (max_gap_us is not None and us - at > max_gap_us):
                at, was = us, float(v)
            elif v >= 0:
                out.append((k[0], us, v - was if v >= was else (v if reset == "emit" else 0.0)))
                at, was = us, float(v)
        if at is not None:
            state.update((at, was))
        yield pd.DataFrame(out, columns=[key, "us", "delta"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(value).cast("double").alias("v")).filter("us IS NOT NULL AND v IS NOT NULL")
    found = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, us long, delta double", "at long, was double", "append", GroupStateTimeout.NoTimeout)
    return found.select(key, F.timestamp_micros("us").alias("ts"), "delta")


def run_to_memory(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, as a table in memory; for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now to Parquet files, each row once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_to_function(stream: DataFrame, fn, checkpoint: str) -> None:
    """Each micro-batch to ``fn(df, number)``: HTTP calls, databases; a number may come again after a failure."""
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
