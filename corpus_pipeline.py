"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.llm import mixture, pieces, pseudonyms, quality, queries, simhash
from matchforge.llm.common import shared_dir
from matchforge.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tokens wanted of the mixture at least, as a multiple of what comes in. Targets are met by repeating, not by leaving
#: out: no rate is below one, and the budget grows where a language has more than that share of it.
BUDGET = 1.2
LEAST_RATE = 1.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id; rows, not ids, are what is kept.

    Shingles have five words; SimHash estimates a similarity of 0.8 and more.
    """
    return simhash.one_of_each(docs.select(*COLUMNS), simhash.SIMILAR)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced by pseudonyms."""
    done = pseudonyms.pseudonymized(docs, queries.PSEUDONYM_KEY)
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, once at least; languages without a target stay as they are."""
    labelled = queries.domains(docs, table(spark, sf_dir, "labels"))
    return mixture.mixed(docs, labelled, queries.TARGETS, BUDGET, LEAST_RATE).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return pieces.piece_digests(docs, pieces.PieceModel.load(queries.tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("simhash near-duplicates", near_duplicate_stage),
    ("pii pseudonyms", pii_stage),
    ("mixture", mixture_stage),
    ("sentencepiece", piece_stage),
]

#: The stages learn models, so SQL can't express them; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/matchforge/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
