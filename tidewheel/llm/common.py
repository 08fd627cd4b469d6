"""Shared pieces of the training-text operators: the shared folder, staged tables, files."""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_root


_ROOTS: dict[str, SparkSession] = {}


def workspace(spark: SparkSession) -> str:
    """This application's folder below the shared one; removed when the driver exits."""
    path = f"{shared_root(spark)}/tidewheel-{spark.sparkContext.applicationId}"
    _ROOTS[path] = spark
    return path


_MODEL: dict = {}


def worker_model(key, make):
    """What ``make`` makes, kept by this worker process until it is asked for something else: one at a time bounds memory."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = make()
    return _MODEL[key]


def slices(batches, rows: int = 1024):
    """Arrow batches of at most so many rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


#: Bytes of a Parquet file's row group, and of a batch that goes to a Python worker, with its most rows.
ROW_GROUP, BATCH_BYTES, BATCH_ROWS = 16 << 20, 16 << 20, 2048


def bounded(spark: SparkSession) -> None:
    """Row groups and batches for Python workers of bounded bytes, unless the session says otherwise."""
    arrow = "spark.sql.execution.arrow"
    for key, value in ((f"{arrow}.maxBytesPerBatch", BATCH_BYTES), (f"{arrow}.maxRecordsPerBatch", BATCH_ROWS), ("parquet.block.size", ROW_GROUP)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    bounded(spark)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewheel_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_tidewheel_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in _ROOTS.items():
        try:
            remove(spark, path)
        except Exception:  # the session has gone already: the files stay for the cluster's own sweep
            pass


def open_store(uri: str):
    """(pyarrow filesystem, path) of a URI; works on executors, without the JVM."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Rows of a side that is broadcast; a larger one is joined by shuffles.
FEW = 100_000
#: Tasks that one step is dealt into at most.
MOST_TASKS = 20_000


def small(side: DataFrame) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast where a count finds it small enough."""
    return F.broadcast(side) if side.limit(FEW + 1).count() <= FEW else side


#: A key is heavy that holds more than one of so many rows; there are fewer heavy keys than this, whatever the input.
HEAVY = 2048


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, which has a row a key and in ``n`` how many of ``rows`` have that key.

    ``how``: inner, left, left_semi or left_anti. Heavy keys, of which there is a fixed bound, are
    broadcast; the others, none of which fills a task, are left to Spark. ``groups`` is read three
    times, so it is to be staged; its keys are not null. ``n`` is not passed on.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(groups.filter(F.col("n") * HEAVY > total).drop("n"))
    light = groups.filter(F.col("n") * HEAVY <= total).drop("n")
    rest = rows.join(heavy.select(*keys), keys, "left_anti")
    if how == "left_anti":
        return rest.join(light.select(*keys), keys, "left_anti")
    if how == "left_semi":
        heavy, light = F.broadcast(heavy.select(*keys)), light.select(*keys)
    return rows.join(heavy, keys, "inner" if how == "left" else how).unionByName(rest.join(light, keys, how))


#: Keys for each shard that its bounds are taken from.
SAMPLED = 20


def range_bounds(rows: DataFrame, key: list[str], shard_bytes: int) -> list[tuple]:
    """Keys that cut ``rows`` (keys of type long, and ``bytes``), sorted by key, into shards of about equal bytes.

    There are as many shards as the bytes of all rows ask for, ``MOST_TASKS`` at most. Keys are drawn by a
    hash of themselves, so bounds are the same however the rows lie; what reaches the driver is about
    ``SAMPLED`` keys a shard, however often a key recurs. Bounds say where rows go, not which.
    """
    n, total = rows.agg(F.count("*"), F.sum("bytes")).first()
    shards = min(MOST_TASKS, max(1, -(-(total or 0) // shard_bytes)))
    if shards == 1:
        return []
    drawn = rows.filter(F.pmod(F.xxhash64(*key), F.lit(max(1, n // (SAMPLED * shards)))) == 0).groupBy(*key).agg(F.sum("bytes").alias("bytes"))
    every = sorted((*r[:-1], r[-1] or 0) for r in drawn.collect())
    whole, seen, bounds = sum(r[-1] for r in every), 0, []
    for r in every:
        seen += r[-1]
        if len(bounds) < shards - 1 and seen * shards >= whole * (len(bounds) + 1):
            bounds.append(r[:-1])
            while len(bounds) < shards - 1 and seen * shards >= whole * (len(bounds) + 1):
                shards -= 1  # one key that fills several shards is one
    return bounds


def shard_of(key: list[str], bounds: list[tuple]) -> Column:
    """How many of the ascending bounds are below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    names = [f"k{k}" for k in range(len(key))]
    kind = f"array<struct<{', '.join(f'{n}: bigint' for n in names)}>>"
    at = F.from_json(F.lit(json.dumps([dict(zip(names, b, strict=True)) for b in bounds])), kind)
    own = F.struct(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    further = lambda found, step: F.when((found + step <= len(bounds)) & (F.get(at, found + step - 1) < own), found + step).otherwise(found)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
