"""documents to packed training sequences: language, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage returns is written as Parquet and read again as the next one's docs. Rows of null or empty text are dropped by the
first stage, which can name no language for them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, near_dedup, packing, quality
from millrace.session import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if its language is this likely at least.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; learns from those that aren't held out."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def resample_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    return quality.resample(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("keep").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.survivors(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", resample_quality),
    ("near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]
#: No SQL expresses the stages; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(spark, docs, name)
    return docs
