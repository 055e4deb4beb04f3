"""Texts as rows: atoms that partition a text exactly, and checks of such partitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LONGEST = 600
HEADING, ITEM = re.compile(r"#{1,6}\s"), re.compile(r"\s*(?:[-*+]|\d+[.)])\s")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
ATOM_SCHEMA = "doc_id long, ordinal int, start long, end long, kind string"


def atoms(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order; what lies between them is white space only. Words of three letters or fewer before a
    full stop count as abbreviations and don't end a sentence; longer pieces than LONGEST are cut at white space."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        s, e = line.span()
        kind = "heading" if HEADING.match(line[0]) else "item" if ITEM.match(line[0]) else "line"
        cuts, at = [], s
        if kind == "line":
            for m in SENTENCE_END.finditer(line[0]):
                word = re.search(r"(\w*)[.!?]$", line[0][: m.start()])
                if word and len(word[1]) > 3:
                    cuts.append((at, s + m.start()))
                    at = s + m.end()
        cuts.append((at, e))
        for a, b in cuts:
            while b - a > LONGEST:
                stop = text.rfind(" ", a + 1, a + LONGEST)
                stop = a + LONGEST if stop <= a else stop
                out.append((a, stop, kind))
                a = stop
            out.append((a, b, kind))
    trimmed = []
    for a, b, kind in out:
        body = text[a:b]
        left, right = len(body) - len(body.lstrip()), len(body.rstrip())
        if right > left:
            trimmed.append((a + left, a + right, kind))
    return trimmed


def atomize(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, start, end, kind) of documents (doc_id, text); offsets in code points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, k, a, b, kind) for d, t in zip(f["doc_id"], f["text"], strict=True) for k, (a, b, kind) in enumerate(atoms(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start", "end", "kind"])

    return docs.select("doc_id", "text").mapInPandas(run, ATOM_SCHEMA)


def coverage(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, covered, overlaps): whether atoms hold all of a text but white space, and how many overlap."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    marked = pieces.withColumn("overlap", F.coalesce(F.col("start") < F.lag("end").over(order), F.lit(False)))
    held = marked.join(docs.select("doc_id", "text"), "doc_id").withColumn("n", F.length(F.regexp_replace(F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))"), r"\s+", "")))
    sums = held.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count_if("overlap").alias("overlaps"))
    solid = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    whole = docs.select("doc_id", solid.alias("solid")).join(sums, "doc_id", "left")
    return whole.select("doc_id", (F.coalesce("n", F.lit(0)) == F.col("solid")).alias("covered"), F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def partition_faults(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, gaps, overlaps, duplicates) of pieces (doc_id, ordinal, start, end) that should cut texts of n characters
    (docs: doc_id, n) without rest: places that no piece covers, pieces that begin before another one ends, ordinals that
    come more than once. A text without pieces is one gap, an empty one none. One row per doc_id, which docs must not
    repeat."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    marked = pieces.withColumn("before", F.coalesce(F.max("end").over(order), F.lit(0))).withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "ordinal")))
    found = marked.groupBy("doc_id").agg(F.count_if(F.col("start") > F.col("before")).alias("gaps"), F.count_if(F.col("start") < F.col("before")).alias("overlaps"), F.count_if(F.col("same") > 1).alias("duplicates"), F.max("end").alias("last"))
    none = lambda x: F.coalesce(x, F.lit(0))
    rest = F.when(F.col("n") > none(F.col("last")), 1).otherwise(0)
    return docs.join(found, "doc_id", "left").select("doc_id", (none(F.col("gaps")) + rest).alias("gaps"), none(F.col("overlaps")).alias("overlaps"), none(F.col("duplicates")).alias("duplicates"))
