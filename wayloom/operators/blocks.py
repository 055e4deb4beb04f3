"""Pairs of rows that agree in some keys, each once. Their number is quadratic in a key's rows by nature, so what is dealt to
the tasks is even shares of the pairs, not keys, and what is told of copies is told once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece, and ids of a group of copies (fixed values): a million pairs at a time.
PIECE, COPIES = 1024, 1024


def dealt(rows: DataFrame, keys: list[str], order: str, size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Left and right sides of the pairs of rows with equal keys, to be joined on keys, _i and _j: a key's rows in order are
    cut into pieces, and piece _i meets piece _j >= _i. The number of tasks is set, since small tables may hold many pairs."""
    own = Window.partitionBy(*keys)
    cut = rows.withColumn("_n", F.floor((F.row_number().over(own.orderBy(order)) - 1) / size).cast("int"))
    cut = cut.withColumn("_last", F.max("_n").over(own))
    left = cut.withColumn("_i", F.col("_n")).withColumn("_j", F.explode(F.sequence("_n", "_last")))
    right = cut.withColumn("_j", F.col("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tuple(side.drop("_n", "_last").repartition(tasks, *keys, "_i", "_j") for side in (left, right))


def row_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs x_id < y_id of rows with equal keys: x_ and y_ of all other columns."""
    left, right = dealt(rows, keys, "id")
    on = [*keys, "_i", "_j"]
    named = lambda side, p: side.select(*on, *[F.col(n).alias(f"{p}_{n}") for n in side.columns if n not in on])
    return named(left, "x").hint("merge").join(named(right, "y"), on).where("x_id < y_id").drop("_i", "_j")


def told_pairs(rows: DataFrame, keys: list[str], alike: list[str], told: Callable[[Callable, Callable], Column], near: str | None = None, own: str | None = None, then: Callable[[Column, Column, Column], Column] | None = None, size: int = PIECE // 16) -> DataFrame:
    """(left_id, right_id, told) of the pairs left_id < right_id of rows with equal keys. ``told`` is a function of the columns
    ``alike`` of both sides, so it is worked out once for all rows that are alike. ``near``: a whole number among alike, in
    which rows of a pair differ by one at most. ``own``: a column that rows that are alike may differ in; ``then`` is the last
    step, of what is told and both values of it, in any order. ``size``: groups of rows that are alike in a piece."""
    item, id_ = (F.struct("id", own), lambda e: e["id"]) if own else (F.col("id"), lambda e: e)
    copies = Window.partitionBy(*keys, *alike).orderBy("id")
    numbered = rows.withColumn("_g", F.floor((F.row_number().over(copies) - 1) / COPIES))
    groups = numbered.groupBy(*keys, *alike, "_g").agg(F.sort_array(F.collect_list(item)).alias("ids"))
    groups = groups.withColumn("first", F.struct(id_(F.get("ids", F.lit(0))).alias("id"), "_g", *alike)).drop("_g")
    on = list(keys)
    if near:  # a group meets those of its own number and of the next: told apart by the role that it has there
        roles = F.array(F.struct(F.col(near).alias("_at"), F.lit(True).alias("_own")), F.struct((F.col(near) + 1).alias("_at"), F.lit(False).alias("_own")))
        groups = groups.withColumn("_r", F.explode(roles)).select("*", "_r.*").drop("_r")
        on.append("_at")
    left, right = dealt(groups, on, "first", size)
    on += ["_i", "_j"]
    named = lambda side, p: side.select(*on, *[F.col(n).alias(f"{p}_{n}") for n in side.columns if n not in on])
    met = named(left, "x").hint("merge").join(named(right, "y"), on).where("x_first <= y_first")
    if near:
        met = met.where("x__own or y__own")
    x, y = (lambda n: F.col(f"x_{n}")), (lambda n: F.col(f"y_{n}"))
    each = met.select((F.col("x_first") < F.col("y_first")).alias("_apart"), told(x, y).alias("_xy"), told(y, x).alias("_yx"), "x_ids", "y_ids")
    # Ids and own values are columns of their own: no struct per pair.
    out = lambda side: F.inline(f"{side}_ids").alias(f"_{side}", f"_{side}_own") if own else F.explode(f"{side}_ids").alias(f"_{side}")
    each = each.select("_apart", "_xy", "_yx", out("x"), "y_ids").select("*", out("y")).where("_x < _y or _apart and _x > _y")
    found = F.when(F.col("_x") < F.col("_y"), F.col("_xy")).otherwise(F.col("_yx"))
    if then:
        found = then(found, F.col("_x_own"), F.col("_y_own"))
    return each.select(F.least("_x", "_y").alias("left_id"), F.greatest("_x", "_y").alias("right_id"), found.alias("told"))
