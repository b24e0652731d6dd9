"""Queries of the operators of this subpackage, over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.llm import audit, crf, licences, lm, mixture, nearest, oddsketch, pages, pieces, pseudonyms, quality, simhash, tries
from matchforge.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    """Where the public tokenizer model lies on this box; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), pieces.PieceModel.load(tokenizer_path()))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The key of these queries; a real run passes its own from where it keeps secrets.
PSEUDONYM_KEY = b"matchforge example key"


@query
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymized(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@query
def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.line_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_lines(table(spark, sf_dir, "documents"))


ORACLES["op2_licences"] = licences.oracle_sql()


@query
def op4_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"))


#: Target shares of tokens of the languages.
TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the languages of the documents that the labelled table covers."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


@query
def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixture.with_rates(docs.select("doc_id", "text"), domains(docs, labels), TARGETS, spare=("text",)).select("doc_id", "n_tokens", "posterior", "rate")


@query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.text_scores(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = audit.oracle_sql()


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = tries.oracle_sql()


@query
def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op12_odd_sketches"] = oddsketch.oracle_sql()
