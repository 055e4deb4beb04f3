"""Day planning of customers' wish lists: what each has ordered is what is to be placed, so groups are as many as customers
and as long as their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.planner import plan_days
from ..sources import catalog as c
from .policy import _modes
from .registry import query


def wishes(spark, sf):
    """Stops to plan per customer: facts of the experience and limits of the request by formula of the keys. Rows are dealt and
    sorted by request while they are narrow."""
    k, q = F.col("experience_id"), F.col("request_id")
    lines = c.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("experience_id"))
    orders = c.read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("request_id"))
    asked = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("request_id", "experience_id")
    e = c.experience(spark, sf).select("experience_id", "duration_minutes", "quality")
    dealt = asked.join(e, "experience_id").repartition(c.tasks(spark, sf, "lineitem"), "request_id").dropDuplicates(["request_id", "experience_id"]).sortWithinPartitions("request_id")
    place = lambda start, step: F.lit(start) + ((k * step) % 2000 - 1000) / F.lit(2e4)
    lat, lon = place(-34.6, 7919), place(-58.4, 104729)
    route = k % 4 == 3  # ends elsewhere than it begins
    off = F.when(route, ((k % 17) - 8) / F.lit(1e3)).otherwise(0.0)
    relevance = F.round(F.when(k % 5 != 0, ((k * 7919) % 1000) / F.lit(1e3)).otherwise(0.0) + (k * 13 % 4) / F.lit(4.0) + F.when(F.col("quality").between(0, 5), F.col("quality")).otherwise(0.0) / 5 * 0.5, 6)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    week = F.array(*[
        F.struct(F.lit(d).alias("weekday"), F.when((k + d) % 7 == 0, F.array().cast("array<struct<start:int,end:int>>")).when((k + d) % 3 == 0, F.array(span(F.lit(540), 720 + k % 60), span(F.lit(900), F.lit(1200)))).otherwise(F.array(span(480 + k % 120, 1080 + k % 121))).alias("ranges"))
        for d in range(7)
    ])
    hours = F.when(k % 3 != 0, F.filter(week, lambda h: (h["weekday"] + k) % 5 != 0))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (q % len(v) + 1).cast("int"))
    return dealt.select(
        "request_id", (q % 4 + 1).cast("int").alias("days"), F.lit(540.0).alias("window_start"), pick(1200.0, 1200.0, 1080.0).alias("window_end"), _modes(q).alias("modes"),
        pick(8e3, 15e3, 3e4).alias("walk_per_day"), pick(1500.0, 4000.0, 8000.0, 2500.0).alias("walk_at_once"), F.when(q % 6 != 0, (q % 7).cast("int")).alias("weekday"),
        "experience_id", relevance.alias("relevance"), ((k + q) % 9 == 0).alias("must"), "duration_minutes", F.when(k % 97 != 0, lat).alias("latitude"), lon.alias("longitude"),
        lat.alias("start_latitude"), lon.alias("start_longitude"), (lat + off).alias("end_latitude"), (lon - off).alias("end_longitude"), (k % 2 == 0).alias("point"), hours.alias("hours"),
        F.when(k % 3 == 1, (k % 40).cast("double")).alias("inner_minutes"), F.when(k % 4 == 1, (k * 53 % 2000).cast("double")).alias("inner_walk_m"), F.when(k % 3 == 1, (k % 30).cast("double")).alias("inner_walk_minutes"),
        F.when(k % 8 == 1, (k * 29 % 1600).cast("double")).alias("inner_longest_m"),
    )


def solution(spark, sf):
    return plan_days(wishes(spark, sf), dealt=True)


@query("op_plan_04_hard_constraints")
def hard_constraints(spark, sf):
    """The day that each stop is placed on under all limits, or every reason against every day."""
    return solution(spark, sf).select("request_id", "experience_id", F.col("placed_day").alias("day"), F.array_join("placed_reasons", ",").alias("reasons"))


@query("op_plan_06_local_improvement")
def local_improvement(spark, sf):
    """Days after moves and swaps, with the steps tried."""
    return solution(spark, sf).where("placed_day is not null").select("request_id", "experience_id", "placed_day", F.col("improved_day").alias("day"), "steps")


@query("op_plan_07_routed_order")
def routed_order(spark, sf):
    """The schedule: nearest feasible stop after the other."""
    rounded = [F.round(x, 3).alias(x) for x in ("start_minute", "end_minute", "travel_minutes", "travel_m")]
    return solution(spark, sf).where("day is not null").select("request_id", "day", "position", "experience_id", *rounded)


@query("op_plan_08_repair")
def repair(spark, sf):
    """Stops that routing proved infeasible, with the binding reason."""
    return solution(spark, sf).where("repair_reason is not null").select("request_id", "experience_id", F.col("improved_day").alias("day"), F.col("repair_reason").alias("reason"))


@query("op_plan_09_solution")
def solved(spark, sf):
    """Per request: stops planned (the score), refused and dropped, steps, legs between stops (all approximate) and totals."""
    s = solution(spark, sf)
    n = lambda x: F.count_if(x)
    return s.groupBy("request_id").agg(
        n(F.col("day").isNotNull()).alias("score"), n(F.col("placed_day").isNull()).alias("refused"), n(F.col("repair_reason").isNotNull()).alias("dropped"), F.max("steps").alias("steps"),
        n(F.col("position") > 1).alias("legs"), F.round(F.coalesce(F.sum("travel_minutes"), F.lit(0.0)), 3).alias("travel_minutes"), F.round(F.coalesce(F.sum("walking_m"), F.lit(0.0)), 3).alias("walking_m"),
    )
