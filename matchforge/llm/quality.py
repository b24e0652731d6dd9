"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.llm import ngrams
from matchforge.llm.common import remainder

FOLDS = 5
#: Documents with at least this score are predicted to be good.
KEEP = 0.3


def quality_model(docs: DataFrame, labels: DataFrame):
    """A column function text -> score from the labelled documents outside the held-out fold.

    Repeated labels of a document count as their mean; rows without id or label
    are left out. Fitted on at most ngrams.SAMPLE labelled documents.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(remainder(F.col("doc_id"), FOLDS) != 0)
    marks = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("mark")).withColumn("class", F.lit("good"))
    score = ngrams.scorer(ngrams.fit(docs, marks))

    def of(text: Column) -> Column:
        return score(text)["scores"][0]

    return of


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs` (doc_id, text).

    Only the text is scored. A null or empty text has the score of the constant
    alone; texts count whole; repeated rows repeat; without any label every score
    is 0.5; an empty table gives an empty one; other columns are ignored. A null
    doc_id isn't held out.
    """
    score = quality_model(docs, labels)
    scored = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= KEEP, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with all their columns."""
    return docs.filter(quality_model(docs, labels)(F.col("text")) >= KEEP)
