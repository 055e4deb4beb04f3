"""Literal texts: folds, whole-word searches with spans of the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.names import fold_column, names_in_texts
from ..operators.windowing import windowed
from ..sources import catalog as c
from .registry import query


def names(spark, sf):
    """Names to look for: the first two words and the third word of every benchmark text."""
    words = F.split(F.trim("text"), r"\s+")
    b = c.read(spark, sf, "benchmark").select(F.array(F.array_join(F.slice(words, 1, 2), " "), F.get(words, F.lit(2))).alias("names"))
    return b.select(F.explode("names").alias("name")).where("name is not null")


@query("op_str_02_literal_fold")
def literal_fold(spark, sf):
    """Every document's folded text, as digest and length."""
    rows = fold_column(c.read(spark, sf, "documents").select("doc_id", "text"), "text", "folded")
    return rows.select("doc_id", F.sha2("folded", 256).alias("folded_sha256"), F.length("folded").cast("long").alias("n_chars"))


@query("op_str_03_whole_words")
def whole_words(spark, sf):
    """Names in documents: how often, and where first in the source text."""
    docs = c.read(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text")
    return names_in_texts(docs, names(spark, sf)).withColumnRenamed("uid", "doc_id")


@query("op_str_04_located_spans")
def located_spans(spark, sf):
    """The source bytes of the first occurrence of each name in each document, whatever their case and marks."""
    docs = c.read(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text")
    return names_in_texts(docs, names(spark, sf), quoted=True).select(F.col("uid").alias("doc_id"), "name", "start", "end", "quoted")


def headed(spark, sf):
    """Documents with every third line under a heading of one of three levels; asked for by their first words."""
    head = lambda line, i: F.concat(F.repeat(F.lit("#"), (F.floor(i / 3) % 3 + 1).cast("int")), F.lit(" "), F.substring(line, 1, 40), F.lit("\n\n"), line)
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.when((i % 3 == 0) & (F.trim(line) != ""), head(line, i)).otherwise(line))
    return c.read(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"), F.substring("text", 1, 60).alias("asked"))


@query("op_txt_08_windows")
def text_windows(spark, sf):
    """Windows of whole documents, 2,000 characters each, up to 4,000 for a unit that stays whole."""
    return windowed(headed(spark, sf), 2000, 4000)
