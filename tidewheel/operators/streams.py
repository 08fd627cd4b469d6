"""Ordered rows: paging, sampling, count windows, merging, zipping, joins and collectors.

A DataFrame has no order, so each operator names its order columns. Positions come from
``with_position``, which numbers rows inside range-dealt parts; nothing is sorted in one task but what
a limit has left.
"""

from __future__ import annotations

import itertools
import queue
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordered import with_position
from ..meta import QueryError

# ---------------------------------------------------------------- projection and hooks


def mapped(df: DataFrame, *columns: Column, keep_null: bool = True) -> DataFrame:
    """A projection; without ``keep_null`` rows whose first column is null go."""
    out = df.select(*columns)
    return out if keep_null else out.filter(F.col(out.columns[0]).isNotNull())


def mapped_batches(df: DataFrame, fn: Callable, schema: str, tasks: int | None = None) -> DataFrame:
    """Any code on Arrow-backed pandas batches, in ``tasks`` tasks if given; unordered."""
    return (df.repartition(tasks) if tasks else df).mapInPandas(fn, schema)


def flattened(df: DataFrame, array: str, out: str = "value") -> DataFrame:
    """A row for each element, with its place."""
    return df.select(*[c for c in df.columns if c != array], F.posexplode(array).alias("idx", out))


@contextmanager
def hooks(first: Callable[[], None] | None = None, finally_: Callable[[BaseException | None], None] | None = None) -> Iterator[None]:
    """Runs ``first``, then the block, then ``finally_`` with what the block raised, if anything."""
    error: BaseException | None = None
    try:
        if first:
            first()
        yield
    except BaseException as e:
        error = e
        raise
    finally:
        if finally_:
            finally_(error)


def peeked(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """``df`` with metrics gathered as it is materialised."""
    return df.observe(name, *metrics)


# ---------------------------------------------------------------- paging and sampling


def limited(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(max(0, n))


def skipped(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The rows from position ``n`` on, by position, so that no task takes them all."""
    return _between(df, max(0, n), None, order)


def _between(df: DataFrame, first: int, last: int | None, order: tuple[str, ...]) -> DataFrame:
    rows = with_position(df, order[0], order[1:], "__pos").filter(F.col("__pos") >= first)
    rows = rows if last is None else rows.filter(F.col("__pos") < last)
    return rows.orderBy("__pos").drop("__pos")


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """The zero-based page; empty for a negative number or a size that is not positive."""
    if number < 0 or size <= 0:
        return df.limit(0)
    return _between(df, number * size, (number + 1) * size, order)


def sampled(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows by chance: a top-n by random keys, so no task holds more than n."""
    return df.orderBy(F.rand(seed)).limit(max(0, n))


def count_windows(df: DataFrame, size: int, step: int, order: str, value: str, omit_partial: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """(start, items): the windows from positions 0, step, 2 step ...

    Every full window, then one more from the next start if any row is left for it, unless partial
    windows are omitted or the step is one. Each row goes to the few windows that hold it.
    """
    if not 0 < step <= size:
        raise QueryError("a window's step is from one to its size")
    rows = with_position(df, order, ties)
    n = rows.agg(F.count("*").alias("n"))
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1)
    held = rows.select("pos", value, F.explode(F.sequence(first, last)).alias("w"))
    windows = held.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("x"))
    windows = windows.select((F.col("w") * step).alias("start"), F.col(f"x.{value}").alias("items"))
    full = F.size("items") == size
    if omit_partial or step == 1:
        return windows.filter(full)
    partial = F.when(F.col("n") < size, 0).otherwise((F.floor((F.col("n") - size) / step) + 1) * step)
    # the count is one row
    return windows.crossJoin(n).filter(full | (F.col("start") == partial)).select("start", "items")


# ---------------------------------------------------------------- several inputs


def concatenated(*inputs: DataFrame) -> DataFrame:
    """All rows of the first input, then of the next: ``src`` tells which."""
    return reduce(DataFrame.unionByName, [df.withColumn("src", F.lit(k)) for k, df in enumerate(inputs)])


def merged_sorted(key: str, seq: str, *inputs: DataFrame, position: str | None = None) -> DataFrame:
    """Sorted inputs as one, in order of (key, input, seq): equal keys come from the first input first.

    ``position``: a column with each row's place instead, without sorting all rows.
    """
    rows = concatenated(*inputs)
    return with_position(rows, key, ("src", seq), position) if position else rows.orderBy(key, "src", seq)


def zipped(order: str, *inputs: DataFrame) -> DataFrame:
    """Rows by position, as long as every input has one: (pos, s0, s1, ...) of structs."""
    rows = [with_position(df, order).select("pos", F.struct(*df.columns).alias(f"s{k}")) for k, df in enumerate(inputs)]
    return reduce(lambda a, b: a.join(b, "pos"), rows)


def first_of_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), seq).alias("r")).select("r.*")


def join_sorted(left: DataFrame, right: DataFrame, key: str, seq: str, how: str = "inner") -> DataFrame:
    """Each left row with the first right row of its key: (key, l, r) of structs; ``how``: inner or left."""
    if how not in ("inner", "left"):
        raise QueryError(f"unknown join {how!r}")
    r = first_of_key(right, key, seq).select(F.col(key), F.struct(*right.columns).alias("r"))
    return left.select(F.col(key), F.struct(*left.columns).alias("l")).join(r, key, how)


def left_join_many(key: str, seq: str, left: DataFrame, *others: DataFrame) -> DataFrame:
    """As a left join with each of the others: (key, s0, s1, ...)."""
    out = left.select(F.col(key), F.struct(*left.columns).alias("s0"))
    for k, df in enumerate(others, 1):
        out = out.join(first_of_key(df, key, seq).select(F.col(key), F.struct(*df.columns).alias(f"s{k}")), key, "left")
    return out


def join_many(key: str, seq: str, *inputs: DataFrame, how: str = "inner") -> DataFrame:
    """The k-th row of a key in each input side by side: (key, dup, s0, s1, ...); ``how``: inner or full.

    One aggregation by (key, position) whatever the number of inputs.
    """
    if how not in ("inner", "full"):
        raise QueryError(f"unknown join {how!r}")
    kinds, parts = [df.select(F.struct(*df.columns)).schema[0].dataType for df in inputs], []
    for k, df in enumerate(inputs):
        rows = df.withColumn("dup", F.row_number().over(W.partitionBy(key).orderBy(seq)))
        sides = [F.struct(*df.columns).alias(f"s{j}") if j == k else F.lit(None).cast(kinds[j]).alias(f"s{j}") for j in range(len(inputs))]
        parts.append(rows.select(key, "dup", *sides))
    sides = [f"s{k}" for k in range(len(inputs))]
    whole = reduce(DataFrame.unionByName, parts).groupBy(key, "dup").agg(*[F.first(s, ignorenulls=True).alias(s) for s in sides])
    return whole.filter(" AND ".join(f"{s} IS NOT NULL" for s in sides)) if how == "inner" else whole


def checked_order(df: DataFrame, key: str, seq: str) -> DataFrame:
    """``df``, failing when a row's key is smaller than that of the row before it by ``seq``."""
    from ..functions.ordered import bounds_of, bucket_of, neighbour

    rows = neighbour(df, [seq], F.col(key), "__before", bucket_of(F.col(seq), bounds_of(df, seq)))
    wrong = F.col("__before") > F.col(key)
    return rows.withColumn(key, F.when(wrong, F.raise_error(F.lit("rows are out of order")).cast(df.schema[key].dataType)).otherwise(F.col(key))).drop("__before")


# ---------------------------------------------------------------- groups


def clustered(df: DataFrame, classifier: Column, order: list[str], fold: list[Column]) -> DataFrame:
    """Groups by a classifier that does not decrease along the order, with the last row of the group before.

    (cluster, the folds, prev): ``fold`` are aggregates of a group's rows, ``prev`` a struct or null.
    """
    from ..functions.ordered import bounds_of, bucket_of, neighbour

    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("last")
    rows = df.withColumn("cluster", classifier)
    groups = rows.groupBy("cluster").agg(*fold, last)
    chunk = bucket_of(F.col("cluster"), bounds_of(rows, "cluster"))
    return neighbour(groups, ["cluster"], F.col("last"), "prev", chunk).drop("last")


def folded(df: DataFrame, order: str, value: str, zero: Column, step: Callable[[Column, Column], Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """A user's fold of the values in order, for each key; a key's values meet in one row."""
    values = F.array_sort(F.collect_list(F.struct(order, value)))
    out = df.groupBy(*keys).agg(values.alias("x"))
    return out.select(*keys, F.aggregate(F.col(f"x.{value}"), zero, step).alias("value"))


def folded_rows(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, zero: Any, step: Callable[[Any, Any], Any], kind: str) -> DataFrame:
    """(keys, value): as ``folded`` with a Python step, for keys of any number of rows.

    Rows are sorted by key and order, which spills, and streamed: a task holds one fold, not a key's rows.
    ``kind`` is the Spark type of the fold.
    """
    names = [*keys, "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, out = None, zero, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, v in zip(*columns, strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, now))
                    at, now = key, zero
                now = step(now, v)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
            out = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, now), strict=True))], schema=schema)

    out = df.select(*keys, F.lit(None).cast(kind).alias("value"))
    schema = to_arrow_schema(out.schema)
    rows = df.repartition(*keys) if keys else df.coalesce(1)
    return rows.sortWithinPartitions(*keys, *order).select(*keys, value).mapInArrow(run, out.schema)


# ---------------------------------------------------------------- collectors


def counted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def last_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the last one."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def unique_by_key(df: DataFrame, key: str) -> DataFrame:
    """``df``'s rows by key, failing when one recurs."""
    found = df.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*df.columns)).alias("r"))
    same = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col(key))
    return found.select(same.alias(key), *[F.col("r")[c].alias(c) for c in df.columns if c != key])


def as_map(df: DataFrame, key: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of ``keys``) with a map of all rows, failing when a key recurs."""
    entries = F.collect_list(F.struct(key, value))
    out = df.groupBy(*keys).agg(entries.alias("e"))
    repeated = F.size("e") != F.size(F.array_distinct(F.transform("e", lambda x: x[key])))
    kind = out.select(F.map_from_entries("e")).schema[0].dataType
    made = F.when(repeated, F.raise_error(F.lit("duplicate key")).cast("string")).isNotNull()
    return out.select(*keys, F.when(made, F.lit(None).cast(kind)).otherwise(F.map_from_entries("e")).alias("map"))


def first_and_last(df: DataFrame, order: list[str]) -> DataFrame:
    """One row (first, last) of structs, null if there are no rows."""
    row, rank = F.struct(*df.columns), F.struct(*order)
    return df.agg(F.min_by(row, rank).alias("first"), F.max_by(row, rank).alias("last"))


def consume(df: DataFrame, fn: Callable[[Row], Any], *order: str) -> int:
    """``fn`` on each row in order, one partition of them on the driver at a time; returns how many."""
    n = 0
    for row in (df.orderBy(*order) if order else df).toLocalIterator():
        fn(row)
        n += 1
    return n


def consume_partitions(df: DataFrame, fn: Callable[[Iterator[Row]], None]) -> None:
    """``fn`` on each partition's rows, on the executors; unordered, the first error ends it."""
    df.foreachPartition(fn)


def indexed(df: DataFrame, *order: str) -> Iterator[tuple[int, Row]]:
    return enumerate(df.orderBy(*order).toLocalIterator())


def write_json_array(df: DataFrame, write: Callable[[str], Any], *order: str) -> int:
    """The rows as one JSON array, written piece by piece, a row a line, so that readers can split it."""
    n = 0
    write("[")
    for row in (df.orderBy(*order) if order else df).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        write((",\n" if n else "") + row["j"])
        n += 1
    write("]")
    return n


def write_json_array_with(df: DataFrame, init: Callable[[], Callable[[str], Any]], *order: str) -> int:
    """As ``write_json_array``, but ``init``, which gives the writer, is called when the first row has come, or there is none."""
    rows = (df.orderBy(*order) if order else df).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()
    first = next(rows, None)
    write, n = init(), 0
    write("[")
    for row in itertools.chain([] if first is None else [first], rows):
        write((",\n" if n else "") + row["j"])
        n += 1
    write("]")
    return n


def json_response(df: DataFrame, *order: str) -> Callable:
    """A WSGI application that answers with the rows as one JSON array, in pieces as they come."""

    def respond(environ: dict, start: Callable) -> Iterator[bytes]:
        chunks = json_chunks(df, *order)
        first = next(chunks)  # a query that fails before its first rows is an error, not half an answer
        start("200 OK", [("Content-Type", "application/json")])
        yield first.encode()
        for chunk in chunks:
            yield chunk.encode()

    return respond


def buffered(rows: Iterable[Any], n: int) -> Iterator[Any]:
    """``rows`` read ahead by up to ``n`` on another thread; an error comes where its row would."""
    if n <= 0:
        raise QueryError("a buffer holds one row at least")
    held: queue.Queue = queue.Queue(n)
    ended, stop = object(), threading.Event()

    def put(item: Any) -> bool:
        while not stop.is_set():
            try:
                held.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def fill() -> None:
        try:
            for row in rows:
                if not put((row, None)):
                    return
            put((ended, None))
        except BaseException as e:  # noqa: BLE001  handed on to the reader
            put((ended, e))

    threading.Thread(target=fill, daemon=True).start()
    try:
        while True:
            row, error = held.get()
            if error is not None:
                raise error
            if row is ended:
                return
            yield row
    finally:
        stop.set()


@contextmanager
def locked(lock: threading.Lock) -> Iterator[None]:
    """Holds ``lock`` while a stream is materialised inside the block."""
    with lock:
        yield


def combined(fn: Callable[..., DataFrame], *inputs: DataFrame) -> DataFrame:
    """A user's operator on one input or several."""
    return fn(*inputs)


def json_chunks(df: DataFrame, *order: str, rows: int = 1000) -> Iterator[str]:
    """The rows as one JSON array in pieces, for a reader that takes them as they come."""
    ordered = df.orderBy(*order) if order else df
    held, first = [], True
    for row in ordered.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        held.append(row["j"])
        if len(held) == rows:
            yield ("[" if first else ",") + ",".join(held)
            held, first = [], False
    yield ("[" if first else "," if held else "") + ",".join(held) + "]"


# ---------------------------------------------------------------- optional scalars


class Optional:
    """A value that may be absent: the first row of a DataFrame's first column, taken when asked for."""

    def __init__(self, df: DataFrame):
        self.df = df.limit(1)

    @staticmethod
    def of(spark: SparkSession, values: Iterable[Any], kind: str) -> Optional:
        return Optional(spark.createDataFrame([(v,) for v in values], f"value {kind}"))

    def map(self, fn: Callable[[Column], Column]) -> Optional:
        name = self.df.columns[0]
        return Optional(self.df.select(fn(F.col(name)).alias("value")).filter("value IS NOT NULL"))

    def filter(self, fn: Callable[[Column], Column]) -> Optional:
        return Optional(self.df.filter(fn(F.col(self.df.columns[0]))))

    def flat_map(self, fn: Callable[[Any], Optional]) -> Optional:
        """What ``fn`` gives for the value; itself where there is none."""
        row = self.df.first()
        return self if row is None else fn(row[0])

    def consume(self, fn: Callable[[Any], None]) -> bool:
        """``fn`` on the value, if there is one; whether there was."""
        row = self.df.first()
        if row is not None:
            fn(row[0])
        return row is not None

    def or_else_get(self, make: Callable[[], Any]) -> Any:
        """The value, or what ``make`` returns, which is called only then."""
        row = self.df.first()
        return make() if row is None else row[0]

    def as_json(self) -> str:
        """The value as JSON; null where there is none."""
        row = self.df.select(F.to_json(F.array(F.col(self.df.columns[0]))).alias("j")).first()
        return "null" if row is None else row["j"][1:-1]

    @staticmethod
    def from_json(spark: SparkSession, text: str, kind: str) -> Optional:
        """The value of a JSON text; null is none."""
        df = spark.range(1).select(F.from_json(F.lit(f"[{text}]"), f"array<{kind}>", {"mode": "FAILFAST"})[0].alias("value"))
        return Optional(df.filter("value IS NOT NULL"))

    def or_(self, other: Optional) -> Optional:
        both = self.df.select(F.col(self.df.columns[0]).alias("value"), F.lit(0).alias("k"))
        both = both.union(other.df.select(F.col(other.df.columns[0]).alias("value"), F.lit(1).alias("k")))
        return Optional(both.orderBy("k").select("value"))

    def get(self, default: Any = None) -> Any:
        row = self.df.first()
        return default if row is None else row[0]

    def or_raise(self, error: Exception) -> Any:
        row = self.df.first()
        if row is None:
            raise error
        return row[0]

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()
