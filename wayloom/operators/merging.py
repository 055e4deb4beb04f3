"""Metadata of one thing from many sources, merged the same whatever the order, grouping or partitioning.

Every kind of field is a minimum or a maximum, or a set of such, over normalised values. So Spark's partial aggregation
does the merge, tasks merge their own rows first, and merging merged rows again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of classification, worst first (constants); what is none of them doesn't stand.
TIERS = ("degraded", "current")
SHAPE = (
    "id long, quality double, themes array<string>, intents array<string>, traits array<string>, dimensioned array<struct<dimension:string,key:string,label:string>>, "
    "classification struct<state:string,evidence:array<string>,payload:string>, other map<string,string>"
)


def _clean(values: Column) -> Column:
    tidy = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    return F.filter(tidy, lambda v: v.isNotNull() & (v != ""))


def _facts(rows: DataFrame) -> DataFrame:
    """(id, kind, key, rank, value, quality): one row per value; the least (rank, value) of a (kind, key) stands."""
    member = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key"), F.lit(0).cast("long").alias("rank"), F.lit("").alias("value"))
    kinds = F.array(*[F.transform(_clean(F.col(f)), member(f)) for f in ("themes", "intents", "traits")])
    known = F.filter(F.coalesce("dimensioned", F.array().cast("array<struct<dimension:string,key:string,label:string>>")), lambda d: (F.trim(d["dimension"]) != "") & (F.trim(d["key"]) != ""))

    def dimension(d: Column) -> Column:
        label = F.coalesce(F.trim(d["label"]), F.lit(""))
        return F.struct(F.lit("dimensioned").alias("kind"), F.concat(F.lower(F.trim(d["dimension"])), F.lit(":"), F.lower(F.trim(d["key"]))).alias("key"), (-F.length(label)).cast("long").alias("rank"), label.alias("value"))

    c = F.col("classification")
    tier = F.array_position(F.array(*map(F.lit, TIERS)), c["state"])
    best = F.struct(F.lit("classification").alias("kind"), F.lit("").alias("key"), (-(tier * 1_000_000_000 + F.coalesce(F.size(c["evidence"]), F.lit(0)))).cast("long").alias("rank"), F.to_json(c).alias("value"))
    chosen = F.when(c.isNotNull() & (tier > 0), F.array(best)).otherwise(F.array().cast("array<struct<kind:string,key:string,rank:bigint,value:string>>"))
    other = F.transform(F.filter(F.map_entries(F.coalesce("other", F.create_map().cast("map<string,string>"))), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != ""),
                        lambda e: F.struct(F.lit("other").alias("kind"), e["key"].alias("key"), (-F.length(e["value"])).cast("long").alias("rank"), e["value"].alias("value")))
    every = F.concat(F.flatten(kinds), F.transform(known, dimension), chosen, other)
    return rows.select("id", F.explode_outer(every).alias("f")).select("id", "f.*")


def merged(rows: DataFrame) -> DataFrame:
    """One row per id of rows of SHAPE, which it has itself, so merges may be merged.

    Themes, intents and traits: sorted union of the lower-cased, trimmed values. Dimensioned traits: by dimension and key,
    with the longest label, of equal ones the smallest. Classification: the better state, then more evidence, then the
    smallest JSON; other states drop out. Other keys: the longest value, then the smallest; blank ones drop out. Quality:
    the greatest from 0 to 5. Nulls and empty lists add nothing; an empty table gives no rows. Strings compare by bytes.
    """
    valid = F.when(F.col("quality").between(0, 5) & ~F.isnan("quality"), F.col("quality"))
    ids = rows.groupBy("id").agg(F.max(valid).alias("quality"))
    best = _facts(rows).where("kind is not null").groupBy("id", "kind", "key").agg(F.min(F.struct("rank", "value")).alias("x"))
    pick = lambda kind, value: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, value)))
    held = best.groupBy("id").agg(
        *[pick(f, F.col("key")).alias(f) for f in ("themes", "intents", "traits")], pick("dimensioned", F.struct("key", F.col("x.value").alias("label"))).alias("d"),
        F.max(F.when(F.col("kind") == "classification", F.col("x.value"))).alias("c"), pick("other", F.struct("key", F.col("x.value").alias("value"))).alias("o"),
    )
    split = lambda d: F.struct(F.substring_index(d["key"], ":", 1).alias("dimension"), F.substring(d["key"], F.length(F.substring_index(d["key"], ":", 1)) + 2, F.length(d["key"])).alias("key"), F.when(d["label"] != "", d["label"]).alias("label"))
    empty = F.array().cast("array<string>")
    return ids.join(held, "id", "left").select(
        "id", "quality", *[F.coalesce(f, empty).alias(f) for f in ("themes", "intents", "traits")], F.coalesce(F.transform("d", split), F.array().cast("array<struct<dimension:string,key:string,label:string>>")).alias("dimensioned"),
        F.from_json("c", "state string, evidence array<string>, payload string").alias("classification"), F.coalesce(F.map_from_entries("o"), F.create_map().cast("map<string,string>")).alias("other"),
    )
