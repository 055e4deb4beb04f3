"""Greedy elimination in rank order, in parallel: of rows that overlap the better one stays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .graph import components

#: Rounds over all rows before what is still open is settled component by component.
ROUNDS = 16


def _one_by_one(part: pd.DataFrame) -> pd.DataFrame:
    """The rule itself on the open edges of one component."""
    better_of: dict[int, list[int]] = {}
    rank: dict[int, int] = {}
    rows = part.sort_values("rank")
    for a, b, r in zip(rows["better"], rows["worse"], rows["rank"], strict=True):
        better_of.setdefault(b, []).append(a)
        rank[a] = r
    # Every better row has a rank; one that is never better is decided last, by rows that are.
    kept: set[int] = set()
    for a in sorted(rank, key=rank.__getitem__):
        if not any(x in kept for x in better_of.get(a, ())):
            kept.add(a)
    last = [b for b in better_of if b not in rank]
    kept |= {b for b in last if not any(x in kept for x in better_of[b])}
    every = set(rank) | set(better_of)
    return pd.DataFrame({"id": sorted(every), "kept": [i in kept for i in sorted(every)]})


def eliminated(rows: DataFrame, pairs: DataFrame, order: list[Column], tables: Tables, rounds: int = ROUNDS) -> DataFrame:
    """(id, by) of the rows that fall to one that stays: ``by`` is the best such row.

    rows (id long and what order needs): best first by order, which is total. pairs (a, b): rows that overlap, either way
    round, repeated or not. Going down the ranks, a row stays unless it overlaps one that has stayed. In a round all rows
    without a better neighbour stay and their neighbours fall; a worse neighbour of one that fell may stay next. So a
    row waits only for those on a falling way to it. What is open after the rounds (long ways from rank to rank) is
    settled in a group per connected component of open pairs, narrow rows of a few numbers.
    """
    ranked = rows.select("id", F.struct(*order).alias("at"))
    both = pairs.where("a <> b").select("a", "b").distinct()
    ends = both.join(ranked.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(ranked.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")
    first = F.col("at_a") < F.col("at_b")
    edges = tables.save(ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"), F.least("at_a", "at_b").alias("at")).distinct())
    live, stayed = edges.select("better", "worse"), []
    fallen: list[DataFrame] = []
    for _ in range(rounds):
        if not live.limit(1).count():
            break
        top = tables.save(live.select(F.col("better").alias("id")).distinct().join(live.select(F.col("worse").alias("id")), "id", "left_anti"))
        down = tables.save(live.join(top.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
        stayed.append(top)
        fallen.append(down)
        # A row that loses all of its better neighbours so is on top in the next round; without any neighbour it stays.
        gone = top.unionByName(down)
        open_ = live.join(gone.withColumnRenamed("id", "better"), "better", "left_anti").join(gone.withColumnRenamed("id", "worse"), "worse", "left_anti")
        alone = live.select(F.col("worse").alias("id")).unionByName(live.select(F.col("better").alias("id"))).distinct().join(gone, "id", "left_anti")
        live = tables.save(open_)
        alone = alone.join(live.select(F.col("better").alias("id")).unionByName(live.select(F.col("worse").alias("id"))), "id", "left_anti")
        stayed.append(tables.save(alone))
    if live.limit(1).count():
        groups = components(live.select(F.col("better").alias("a"), F.col("worse").alias("b")), tables)
        numbered = live.join(edges, ["better", "worse"]).join(groups.select(F.col("node").alias("better"), "component"), "better")
        by_rank = F.dense_rank().over(Window.partitionBy("component").orderBy("at"))
        settled = numbered.select("component", "better", "worse", by_rank.alias("rank")).groupBy("component").applyInPandas(_one_by_one, "id long, kept boolean")
        stayed.append(tables.save(settled.where("kept")).select("id"))
    keep = stayed[0] if stayed else edges.select(F.col("better").alias("id")).limit(0)
    for s in stayed[1:]:
        keep = keep.unionByName(s)
    keep = tables.save(keep.distinct())
    held = edges.join(keep.withColumnRenamed("id", "better"), "better", "left_semi")
    return held.groupBy(F.col("worse").alias("id")).agg(F.min_by("better", "at").alias("by"))

