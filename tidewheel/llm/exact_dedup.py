"""Operator 2: exact duplicates by progressive refinement, in DataFrame operations only.

Rows are grouped by normalised length; rows whose length occurs again by length and prefix hash;
rows whose prefix hash occurs again by length and SHA-256 of the whole normalised text. Texts are
equal when identical after deleting the six characters of ``[\\x20\\x09-\\x0D]``. Every grouping is a
pre-aggregated count, so a group of any size shuffles a few rows a task, and texts are never
shuffled: one pass turns each row into a sketch of lengths and hashes. The full hash belongs to that
pass, for the result has it for every row, and a second reading of the texts would cost more than it saves.
Rows meet their group's count by a join that deals heavy keys apart (``split_join``).

Of equal texts the row with the most code points stays, then the smallest id (null ids last), then,
of rows repeated with their id, one. Null text counts as empty; empty texts are equal to each other.
Other columns of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small, split_join, stage, table

#: Characters that count for nothing: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
PREFIX = 256


def normalised(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    flat = raw.select("doc_id", F.char_length("t").alias("chars"), normalised(F.col("t")).alias("t"))
    sketch = stage(
        flat.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "chars",
            F.char_length("t").alias("length"),
            F.xxhash64(F.substring("t", 1, PREFIX)).alias("prefix"),
            F.sha2("t", 256).alias("text_sha256"),
        ),
        "exact",
    )
    by_length = _recurring(sketch, "length")
    by_prefix = _recurring(by_length, "length", "prefix")
    # the best row is the largest of (chars, -id, -row); ~x is -x - 1, without overflow
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("i"), F.bitwise_not("row").alias("r")))
    groups = by_prefix.groupBy("length", "text_sha256").agg(F.count("*").alias("n"), best.alias("best")).filter("n > 1")
    groups = groups.select("length", "text_sha256", "n", F.col("n").alias("group_size"), F.bitwise_not("best.i").alias("best_id"), F.bitwise_not("best.r").alias("best_row"))
    both = split_join(sketch, stage(groups, "exact_groups"), ["length", "text_sha256"], "left")
    return both.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def _recurring(df: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur more than once."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return split_join(df, stage(groups, "recurring"), list(keys), "left_semi")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that do not stay; columns unchanged.

    Whole texts are hashed once, by ``exact_duplicates``; rows then go by their ids. Only ids of which some
    rows stay and others go, such as rows repeated with their id, are hashed again to tell the rows apart.
    """
    found = stage(exact_duplicates(docs, doc_id, text).select("doc_id", "kept", "text_sha256"), "exact_found")
    other, sha = fresh(docs, "__other"), fresh(docs, "__sha")
    ids = found.groupBy("doc_id").agg(F.count_if(~F.col("kept")).alias("gone"), F.count("*").alias("rows")).filter("gone > 0")
    ids = stage(ids.select(F.col("doc_id").alias(other), (F.col("gone") < F.col("rows")).alias("some")), "exact_gone")
    every, some = small(ids.select(other)), small(ids.filter("some").select(other))
    out = docs.join(every, F.col(doc_id).eqNullSafe(every[other]), "left_anti")
    if some.isEmpty():
        return out
    rows = docs.join(some, F.col(doc_id).eqNullSafe(some[other]), "left_semi").withColumn(sha, F.sha2(normalised(F.col(text)), 256))
    kept = found.filter("kept").join(some, F.col("doc_id").eqNullSafe(some[other]), "left_semi")
    kept = small(stage(kept.select(F.col("doc_id").alias(other), F.col("text_sha256").alias(f"{sha}_")), "exact_kept"))
    rows = rows.join(kept, F.col(doc_id).eqNullSafe(kept[other]) & (F.col(sha) == kept[f"{sha}_"]), "left_semi")
    most = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.char_length(text), F.lit(0))).alias("r")
    return out.unionByName(rows.groupBy(doc_id, sha).agg(most).select("r.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
