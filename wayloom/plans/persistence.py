"""Persistence: observed places merged into the stored catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.upsert import upserted
from ..sources import catalog as c
from ..sources.shared import Tables
from .overlap import NAMES
from .registry import query


def stored(spark, sf):
    """Suppliers as stored entities, each with an id of its provider."""
    k = F.col("entity_id")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    entities = c.geo_entity(spark, sf).where(k < 1000003).select(k, name.alias("name"), "kind", "latitude", "longitude")
    return entities, entities.select(F.concat(F.lit("crm:"), k.cast("string")).alias("id"), k)


def observed(spark, sf):
    """Customers as observed places: under known ids, beside stored places, beside each other, under ids of two."""
    k = F.col("c_custkey")
    near = F.when(k % 3 == 0, k % 97 + 1).otherwise(k)
    place = lambda start, step: F.lit(start) + ((near * step) % 2000 - 1000) / F.lit(1e4) + (k % 7) * F.lit(1e-4)
    name = F.element_at(F.array(*map(F.lit, NAMES)), ((near + F.when(k % 5 == 0, 1).otherwise(0)) % len(NAMES) + 1).cast("int"))
    known = F.concat(F.lit("crm:"), (k % 89 + 1).cast("string"))
    ids = F.when(k % 8 == 0, F.array(known)).when(k % 31 == 1, F.array(known, F.lit("crm:7"))).when(k % 6 == 1, F.array(F.concat(F.lit("osm:"), F.floor(k / 9).cast("string")))).otherwise(F.array(F.concat(F.lit("osm:c"), k.cast("string"))))
    kind = F.when(near % 10 < 7, "PLACE").when(near % 10 < 9, "AREA").otherwise("ROUTE")
    return c.read(spark, sf, "customer").select(k.alias("seq"), ids.alias("ids"), name.alias("name"), kind.alias("kind"), F.when(k % 50 != 0, place(-34.6, 7919)).alias("latitude"), place(-58.4, 104729).alias("longitude"))


@query("op_er_23_entity_upsert")
def entity_upsert(spark, sf):
    """What becomes of every observed place."""
    return upserted(*stored(spark, sf), observed(spark, sf), Tables(spark, "upsert"))[2].select("seq", "outcome", "entity_id")


@query("op_er_24_persisted_entities")
def persisted(spark, sf):
    """The stored entities after the batch, with the number of their ids."""
    entities, identities, _ = upserted(*stored(spark, sf), observed(spark, sf), Tables(spark, "upsert"))
    n = identities.groupBy("entity_id").agg(F.count("*").alias("n_ids"))
    return entities.join(n, "entity_id", "left").select("entity_id", "name", "kind", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"))
