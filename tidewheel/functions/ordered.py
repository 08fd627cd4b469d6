"""Access to neighbouring rows of one long series without putting it into one task.

A window without partitions sorts all rows in one place. Here rows are cut into chunks of their order
key, windows run inside chunks, and what a chunk needs of the others comes from a table of a row a
chunk, which is tiny beside the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def chunk_of(ts: Column, us: int = HOUR_US) -> Column:
    """Chunks of time; an hour of one series is to fit a task, which spills, and hours a table of one."""
    return F.floor(F.unix_micros(ts) / us)


def neighbours(df: DataFrame, order: list[str], taken: Column, chunk: Column, before: str | None = None, after: str | None = None, where: Column | None = None) -> DataFrame:
    """``df`` with ``before`` and ``after``, where named: ``taken`` of the last row strictly before each row, and of the first after it, for which ``where`` holds.

    ``chunk`` must not decrease along ``order``; rows without one go. Rows are dealt out by chunk once: the
    windows inside chunks and the table of chunk edges read the same exchange.
    """
    where = F.lit(True) if where is None else where
    held = df.withColumn("__chunk", chunk).filter(F.col("__chunk").isNotNull()).withColumn("__taken", F.when(where, F.struct(taken.alias("v"))))
    held = held.repartition(F.col("__chunk"))
    # whole rows are compared for their order alone; naming every column lets both readers share the exchange
    row, rank = F.struct(*[F.col(f"`{c}`") for c in held.columns]), F.when(F.col("__taken").isNotNull(), F.struct(*order))
    edges = held.groupBy("__chunk").agg(F.max_by(row, rank).alias("__last"), F.min_by(row, rank).alias("__first")).withColumnRenamed("__chunk", "__edge")
    inside, carried, out = W.partitionBy("__chunk").orderBy(*order), [F.col("__edge")], {}
    for name, edge, across, frame, near in (
        (before, "__last", W.orderBy("__edge"), inside.rowsBetween(W.unboundedPreceding, -1), F.last),
        (after, "__first", W.orderBy(F.desc("__edge")), inside.rowsBetween(1, W.unboundedFollowing), F.first),
    ):
        if name:
            carried.append(F.last(F.col(edge)["__taken"], ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias(f"__far_{edge}"))
            held = held.withColumn(f"__near_{edge}", near("__taken", ignorenulls=True).over(frame))
            out[name] = F.coalesce(f"__near_{edge}", f"__far_{edge}")["v"]
    found = held.join(edges.select(*carried), F.col("__chunk") == F.col("__edge"), "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def neighbour(df: DataFrame, order: list[str], taken: Column, out: str, chunk: Column, where: Column | None = None) -> DataFrame:
    """``df`` with ``out``: ``taken`` of the last row strictly before each row for which ``where`` holds; see ``neighbours``."""
    return neighbours(df, order, taken, chunk, before=out, where=where)


def running_total(df: DataFrame, value: str, order: list[str], out: str, chunk: Column, group: Column) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its group up to and with each row.

    ``chunk`` must not decrease along ``order`` inside a group.
    """
    held = df.withColumn("__group", group).withColumn("__chunk", chunk)
    sums = held.groupBy("__group", "__chunk").agg(F.sum(value).alias("__sum"))
    across = W.partitionBy("__group").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("__group").alias("__g"), F.col("__chunk").alias("__c"), F.coalesce(F.sum("__sum").over(across), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__group", "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = held.withColumn(out, F.sum(value).over(inside))
    held = held.join(sums, F.col("__group").eqNullSafe(F.col("__g")) & F.col("__chunk").eqNullSafe(F.col("__c")))
    return held.withColumn(out, F.col(out) + F.col("__before")).drop("__group", "__chunk", "__g", "__c", "__before")


#: Values for each part that bounds of text are taken from.
SAMPLED = 20


def bounds_of(df: DataFrame, key: str, parts: int | None = None) -> list:
    """Values that cut ``df`` into about equal parts by a column; one narrow scan.

    Numbers and times are cut at approximate quantiles, other types at those of a random sample of
    ``SAMPLED`` values a part. Bounds say where rows go, not which; none is left out.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return []
    if isinstance(df.schema[key].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        found = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 1000).alias("b")).first()["b"]
    else:
        some = df.select(key).filter(F.col(key).isNotNull()).orderBy(F.rand(42)).limit(SAMPLED * parts).collect()
        every = sorted(r[0] for r in some)
        found = [every[len(every) * k // parts] for k in range(1, parts)] if every else None
    return sorted({b for b in found or [] if b is not None})


def bucket_of(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are below the key (0 for null), by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    at = F.array(*map(F.lit, bounds))
    further = lambda found, step: F.when((found + step <= len(bounds)) & (F.get(at, found + step - 1) < key), found + step).otherwise(found)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def with_position(df: DataFrame, key: str, ties: tuple[str, ...] = (), out: str = "pos", parts: int | None = None) -> DataFrame:
    """``df`` with each row's zero-based position by (key, ties)."""
    held = df.withColumn("__part", bucket_of(F.col(key), bounds_of(df, key, parts)))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"))
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(key, *ties))
    return held.withColumn("__row", inside).join(counts, "__part").withColumn(out, F.col("__before") + F.col("__row") - 1).drop("__part", "__row", "__before")
