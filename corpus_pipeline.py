"""A corpus pipeline: quality, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the one before it kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import Scratch, table, unused
from wayloom.llm.jaccard import representatives
from wayloom.llm.mixing import emit, mix_sources
from wayloom.llm.quality import THRESHOLD, fit_quality, score_quality
from wayloom.llm.sentencepieces import default_model, encode_column
from wayloom.llm.suffixes import dedup_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from all labelled documents of the input that aren't held out.

    Null and empty texts have the score of an empty text; rows that repeat a document or a doc_id are scored one by one; a
    score equal to the threshold stays. An empty table, and one without labelled documents (score 0.5), lose nothing. All
    columns pass, whatever their names.
    """
    model, score = fit_quality(docs, table(spark, sf_dir, "labels")), unused(docs, "_quality")
    return score_quality(docs, model, score).where(F.col(score) >= THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row of its smallest doc_id.

    Null and empty texts and rows without a doc_id link with nothing and stay; rows that repeat a doc_id with another text
    are documents of their own; of rows that repeat both one stays. An empty table gives an empty one.
    """
    return representatives(docs, Scratch(spark, "near"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte covered by a 200-byte string that occurs elsewhere too is cut; rows of which nothing is left go.

    So do null and empty texts, which hold nothing to begin with. Rows that repeat a document cover each other whole and
    both go; the stage before leaves none. Columns named like this stage's own pass unchanged. An empty table stays empty.
    """
    cut = dedup_repeats(docs, Scratch(spark, "repeats"))
    return cut.where(F.length("text") > 0)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many rows as the mix takes copies of them.

    A null source is a source of its own; null and empty texts have size 0 and ride along in their source's line; ties of
    size and doc_id are interchangeable; repeated rows are documents of their own. All columns pass. An empty table stays
    empty.
    """
    return emit(mix_sources(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, how: str = "auto") -> DataFrame:
    """doc_id, source, token_ids and n_tokens of each row; ``how``: the segmentation that the model file asks for (auto),
    ``merge`` or ``viterbi``. Null and empty texts have no tokens. Rows that repeat a document each give one; an empty
    table gives an empty one; other columns are not read."""
    coded = encode_column(docs.select("doc_id", "source", "text"), default_model(), how=how)
    return coded.select("doc_id", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = scratch.save(docs) if k + 1 < len(STAGES) else docs
    return docs


#: The classifier and the suffix stage can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None
