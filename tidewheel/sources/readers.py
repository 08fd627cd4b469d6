"""Batch sources."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader


def rows(spark: SparkSession, given: Iterable, schema: str) -> DataFrame:
    """Rows in memory, with their place as ``seq``."""
    kind = T._parse_datatype_string(schema)
    one = isinstance(kind, T.StructType) and len(kind) == 1
    made = [(*(r if isinstance(r, tuple) else (r,)), k) for k, r in enumerate(given)] if one else [(*r, k) for k, r in enumerate(given)]
    return spark.createDataFrame(made, T.StructType([*kind.fields, T.StructField("seq", T.LongType())]))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def failing(spark: SparkSession, message: str, schema: str) -> DataFrame:
    """A source that fails when it is read."""
    kind = T._parse_datatype_string(schema)
    return spark.range(1).select(*[F.raise_error(F.lit(message)).cast(f.dataType).alias(f.name) for f in kind.fields])


def from_mapping(spark: SparkSession, given: Mapping, key: str, value: str, what: str = "entries") -> DataFrame:
    """A mapping's entries, keys or values (``key`` and ``value``: Spark types); of no order."""
    df = spark.createDataFrame(list(given.items()), f"key {key}, value {value}")
    return {"entries": df, "keys": df.select("key"), "values": df.select("value")}[what]


def exploded_map(df: DataFrame, column: str) -> DataFrame:
    """(key, value) of a map column."""
    return df.select(F.explode(column).alias("key", "value"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def lines(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """(line, seq) of a text file; a missing file is empty. Reversed, the last line has ``seq`` 0.

    The file is read in splits; a line's number comes from its split and place there.
    """
    if not _exists(spark, path):
        return empty(spark, "line string, seq long")
    df = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    from ..functions.ordered import with_position

    df = with_position(df, "id", out="seq").drop("id")
    if reverse:
        last = df.agg(F.max("seq").alias("last"))  # one row
        df = df.crossJoin(last).select("line", (F.col("last") - F.col("seq")).alias("seq"))
    return df


def query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A query on a database by JDBC; ``partitionColumn``, ``lowerBound`` and so on deal it out."""
    reader = spark.read.format("jdbc").option("url", url).option("query", sql)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


#: A string of JSON, or a character that opens, closes or parts.
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},]')
#: Lines that are looked at together.
_LINES = 1 << 16


def _parts(spark: SparkSession, path: str, opening: str, what: str) -> DataFrame:
    """(seq, text) of the elements or members of a file's top-level JSON value.

    The file is read by lines, in splits. A line's depth comes from running sums of what lines open and close
    (no string goes over a line's end), its pieces from its own text, and a piece's number from a running sum
    of the commas at depth one. So a task holds lines and single elements, and never the file; one that has
    no line breaks is one line.
    """
    closing = {"[": "]", "{": "}"}[opening]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, line, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = k = 0
                for m in _TOKEN.finditer(line):
                    c = m[0]
                    if depth == 0 and (c != opening or line[at : m.start()].strip()):
                        raise ValueError(f"the JSON is no {what}")
                    if depth == 1 and c in (",", closing):
                        out.append((pos, k, line[at : m.start()], 1))
                        at, k = m.end(), k + 1
                    if c in "[{":
                        depth += 1
                        at = m.end() if depth == 1 else at
                    elif c in "]}":
                        depth -= 1
                rest = line[at:]
                if rest.strip():
                    if depth < 1:
                        raise ValueError(f"the JSON is no {what}")
                    out.append((pos, k, rest, 0))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], names=["pos", "k", "text", "ends"])

    from ..functions.ordered import running_total

    def several(c: str) -> Column:
        return F.length(F.regexp_replace("bare", f"[^{c}]", ""))

    rows = lines(spark, path).select(F.col("seq").alias("pos"), "line")
    rows = rows.withColumn("bare", F.regexp_replace("line", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")).withColumn("delta", several(r"\[{") - several(r"\]}"))
    chunk = F.floor(F.col("pos") / _LINES)
    rows = running_total(rows, "delta", ["pos"], "after", chunk, F.lit(0))
    found = rows.select("pos", "line", (F.col("after") - F.col("delta")).cast("int").alias("depth")).mapInArrow(cut, "pos long, k int, text string, ends int")
    found = running_total(found, "ends", ["pos", "k"], "done", chunk, F.lit(0)).withColumn("seq", F.col("done") - F.col("ends"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "text"))), lambda x: x["text"])
    return found.groupBy("seq").agg(F.trim(F.array_join(pieces, "\n")).alias("text")).filter("text <> ''")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each element of the top-level array of a JSON file; another top level is an error."""
    one = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), f"array<{_element(schema)}>")[0]
    return _parts(spark, path, "[", "array").select("seq", one.alias("e")).select("e.*", "seq")


def json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) for each member of the top-level object of a JSON file."""
    one = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{value}>")
    return _parts(spark, path, "{", "object").select(F.explode(one).alias("key", "value"))


def _element(schema: str) -> str:
    return T._parse_datatype_string(schema).simpleString()


def packed(fn: Callable) -> str:
    """A function as the text of an option."""
    return base64.b64encode(cloudpickle.dumps(fn)).decode()


def unpacked(text: str) -> Callable:
    return cloudpickle.loads(base64.b64decode(text))


class IteratorSource(DataSource):
    """Rows of a Python function, a partition for each of its ``parts``: option ``function`` holds it, pickled."""

    @classmethod
    def name(cls) -> str:
        return "tidewheel_rows"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _IteratorReader(int(self.options.get("parts", "1")), self.options["function"])


class _IteratorReader(DataSourceReader):
    def __init__(self, parts: int, function: str):
        self.parts, self.function = parts, function

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition) -> Iterator[tuple]:
        yield from unpacked(self.function)(partition.value)


def from_function(spark: SparkSession, fn: Callable[[int], Iterable[tuple]], schema: str, parts: int = 1) -> DataFrame:
    """Rows of a function of a part's number."""
    spark.dataSource.register(IteratorSource)
    reader = spark.read.format("tidewheel_rows").option("schema", schema).option("parts", str(parts))
    return reader.option("function", packed(fn)).load()


def from_optional(spark: SparkSession, value: Any, schema: str) -> DataFrame:
    """One row, or none for None."""
    return spark.createDataFrame([] if value is None else [(value,)], schema)
