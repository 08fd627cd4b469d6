"""A pipeline over ``documents``: language, quality, exact and near duplicates, packing.

Each stage takes what its predecessor kept, as written to Parquet and read again, and all but the last
return its columns as they are, whatever further columns there are. Models are learned from the
``documents`` and ``labels`` of ``sf_dir`` that are not held out.

* language: null and empty texts have no letter and go. Repeated rows are judged alike.
* quality: a text without a word scores by the intercept. With no label every score is 0.5, and all stay.
* exact_dedup: of equal texts the longest, then of smallest id, then one of the rows repeated with it stays.
* near_dedup: of near copies the one of smallest id stays; null ids come last.
* packing: a row a packed sequence; see ``tidewheel.llm.packing``.

Very long texts are taken whole by every stage. An empty table passes as an empty table. Staged tables
lie in the shared folder, so a lost executor costs its tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import exact_dedup, language, packing, quality, simhash
from tidewheel.llm.common import fresh, stage, table


#: Languages that stay, by their names in ``lang``; None: every one that is learned.
LANGUAGES: tuple[str, ...] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in one of ``LANGUAGES``; those like no learned language go, and those without a letter."""
    return language.in_languages(docs, language.language_model(table(spark, sf_dir, "documents")), LANGUAGES)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    weights = quality.quality_model(spark, sf_dir)
    rate = fresh(docs, "__rate")
    return quality.score(docs, weights, out=rate).filter(F.col(rate) >= quality.THRESHOLD).drop(rate)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in packed sequences."""
    return packing.pack_texts(docs)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("packing", pack),
]

#: SQL cannot express the learned stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
