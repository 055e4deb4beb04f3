"""What sources say: listings of wiki pages, metadata of one experience from all its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.merging import merged
from ..operators.templates import audit, listings
from ..sources import catalog as c
from .registry import query

#: Templates of a page's lines by key (constants): whole, nested, unbalanced, nameless, unsupported, under a heading.
FORMS = (
    "{{{{see|name=[[{p}|The {p}]]|lat=-34.{k}|long=-58.5|content=Old &amp; <b>new</b> {{{{small|{{{{x|y}}}}}}}} [https://x.org/a?b=c see there]|wikidata=q{k}}}}}",
    "== Hacer y ver ==\n{{{{listing|type=eat|nombre={p}|lat=91|long=.5|wikidata=Q{k} and more}}}}", "{{{{listado|name={p} {{{{!}}}} bar|descripción=a | b=c}}}}\n== Comer ==", "{{{{do|lat=1|content={p}}}}}",
    "{{{{eat|name= |content=x}}}} {{{{ comer|name={p}}}}}", "{{{{infobox|name={p}|in={{{{ver|name=inner}}}}}}}} }}}} text", "{{{{see|name={p} {{{{hacer|name=inside {k}}}}}\nnever closed", "{{{{listing|name=<i></i>}}}}{{{{VER|NAME = {p}|long=-180|lon=7}}}}",
)


def pages(spark, sf):
    """One wiki page per order, a template per line."""
    lines = c.read(spark, sf, "lineitem").join(c.read(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    form = F.element_at(F.array(*[F.lit(f.replace("{{", "{").replace("}}", "}")) for f in FORMS]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(FORMS) + 1).cast("int"))
    said = F.replace(F.replace(form, F.lit("{p}"), F.col("p_name")), F.lit("{k}"), F.col("l_suppkey").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", said.alias("t")))), lambda x: x["t"])
    return lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(parts, "\n").alias("text"))


@query("op_src_15_wiki_listings")
def wiki_listings(spark, sf):
    return listings(pages(spark, sf)).where("dropped is null").drop("dropped")


@query("op_src_15_wiki_audit")
def wiki_audit(spark, sf):
    return audit(listings(pages(spark, sf)))


def metadata(spark, sf):
    """What each line says of its experience: themes in odd case, labelled dimensions, classifications, other keys. Lines are
    dealt by experience while they are three numbers; what is merged of them needs no other shuffle."""
    lines = c.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey").repartition(c.tasks(spark, sf, "lineitem"), "l_partkey")
    li = lines.join(c.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    k, s, words = F.col("l_orderkey"), F.col("l_suppkey"), F.split("p_name", " ")
    said = lambda v, *names: F.element_at(F.array(*map(F.lit, names)), (v % len(names) + 1).cast("int"))
    state = said(k, "current", "degraded", "stale", "degraded")
    return li.select(
        F.col("l_partkey").alias("id"), ((k + s) % 70 / F.lit(10.0) - 1).alias("quality"), F.when(k % 7 != 0, F.array(F.concat(F.lit(" "), F.upper(words[0])), F.get(words, F.lit(1)), F.lit(""))).alias("themes"),
        F.array(said(s, "Walk", "walk ", "EAT", "see")).alias("intents"), F.when(k % 3 == 0, F.array(F.col("p_brand"), F.lit(None).cast("string"))).alias("traits"),
        F.array(F.struct(said(k, "Mood", "mood ", "access", "").alias("dimension"), said(s, "Calm", "calm", "quiet").alias("key"), said(k + s, "Calm", "Very calm", None, "So calm!!").alias("label"))).alias("dimensioned"),
        F.when(k % 5 != 0, F.struct(state.alias("state"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (s % 4).cast("int")).alias("evidence"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("payload"))).alias("classification"),
        F.create_map(F.lit("note"), said(k, "long note", "a", "b", " ", "tie 1 no", "tie 2 no"), said(s, "price", "tips"), (s % 9).cast("string")).alias("other"),
    )


@query("op_agg_16_metadata_merge")
def metadata_merge(spark, sf):
    """The merged metadata of every experience, as text."""
    m = merged(metadata(spark, sf))
    join = lambda c: F.array_join(c, ",")
    dims = F.transform("dimensioned", lambda d: F.concat_ws(":", d["dimension"], d["key"], d["label"]))
    other = F.transform(F.array_sort(F.map_entries("other")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select(F.col("id").alias("experience_id"), F.round("quality", 6).alias("quality"), join("themes").alias("themes"), join("intents").alias("intents"), join("traits").alias("traits"), join(dims).alias("dimensioned"), F.to_json("classification").alias("classification"), join(other).alias("other"))
