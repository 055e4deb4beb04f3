"""The derived catalog: entities, experiences, components, facets and requests as pure functions of the base tables.

Every table is given twice, as a DataFrame and as the SQL of the same rows (``CTE``), with the same IEEE operations in the
same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quality import final_quality

#: Requests: id, latitude, longitude, radius in metres, days, pace, theme asked for.
REQUESTS = (
    (1, -34.60, -58.40, 2500.0, 1, "moderate", "ring"),
    (2, -34.55, -58.35, 4000.0, 2, "relaxed", "gear"),
    (3, -34.65, -58.45, 1500.0, 3, "fast", "bolt"),
    (4, -34.58, -58.33, 6000.0, 1, "moderate", "red"),
    (5, -34.70, -58.50, 800.0, 2, "relaxed", "blue"),
    (6, -33.00, -60.00, 5000.0, 1, "fast", "ring"),
)
REQUEST_SCHEMA = "request_id int, latitude double, longitude double, radius_m double, days int, pace string, theme string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str, rows: int = 250_000) -> int:
    """Partitions that hold so many rows of a table each, at least those that a shuffle has by default (with less, a join would
    shuffle again): a task's memory doesn't grow with the table. Rows are counted by the footers of the files."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, sf_dir, name).count() // rows))


def _coordinate(start: float, step: int, key: F.Column) -> F.Column:
    return F.lit(start) + ((key * step) % 2000 - 1000) / F.lit(1e4)


def geo_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, kind, latitude, longitude of suppliers and customers."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000003).alias("key"), F.col("c_name").alias("name"))
    key = F.col("key")
    kind = F.when(key % 10 < 7, "PLACE").when(key % 10 < 9, "AREA").otherwise("ROUTE")
    return s.unionByName(c).select(key.alias("entity_id"), "name", kind.alias("kind"), _coordinate(-3.46e1, 7919, key).alias("latitude"), _coordinate(-5.84e1, 104729, key).alias("longitude"))


def experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: name, price, duration, signals, quality and status."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    e = p.select(
        k.alias("experience_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") * 3 + 30).cast("long").alias("duration_minutes"),
        F.when(k % 11 != 0, (k * 37 % 51) / F.lit(1e1)).alias("rating"), ((k * 101) % 3000).alias("reviews"), F.when(k % 4 == 0, (k * 13) % 400).alias("notability"), (k % 3 == 0).alias("editorial"),
        F.when(k % 7 == 0, "DRAFT").otherwise("VERIFIED").alias("status"), F.col("p_type").alias("kind"), F.lower("p_brand").alias("brand"),
    )
    return e.withColumn("quality", final_quality(F.col("rating"), F.col("reviews"), F.col("notability"), F.col("editorial")))


def component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (experience, entity) pairs in source order; some unresolved."""
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("experience_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    order = Window.partitionBy("experience_id").orderBy("entity_id")
    return pairs.select("experience_id", "entity_id", F.row_number().over(order).alias("position"), F.when((F.col("experience_id") + F.col("entity_id")) % 13 == 0, "UNRESOLVED").otherwise("RESOLVED").alias("state"))


def resolved_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experience_id, entity_id) of resolved members, repeated as often as the source says so: for semi joins and minima,
    which need no distinct pairs and no order."""
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("experience_id"), F.col("l_suppkey").alias("entity_id"))
    return pairs.where((F.col("experience_id") + F.col("entity_id")) % 13 != 0)


def facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (experience_id, dimension, facet): themes from the words of the name, a trait from the brand."""
    p = read(spark, sf_dir, "part")
    themes = p.select(F.col("p_partkey").alias("experience_id"), F.lit("theme").alias("dimension"), F.explode(F.split(F.lower("p_name"), " ")).alias("facet"))
    traits = p.select(F.col("p_partkey").alias("experience_id"), F.lit("trait").alias("dimension"), F.lower("p_brand").alias("facet"))
    return themes.unionByName(traits).distinct()


def request(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REQUESTS), REQUEST_SCHEMA)


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a durable queue: status, attempts and creation time."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type").isin("click", "view"), "PROCESSED").when(F.col("event_type") == "purchase", "PROCESSING").otherwise("PENDING")
    return e.select("event_id", status.alias("status"), F.col("ts").alias("created_at"), (F.col("event_id") % 6).cast("int").alias("attempts"), "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


_LOG = "least(1e0, greatest(0e0, log10(1e0 + {n}) / log10(1e0 + {cap})))"
CTE = {
    "geo_entity": """geo_entity AS (SELECT key AS entity_id, name, CASE WHEN key % 10 < 7 THEN 'PLACE' WHEN key % 10 < 9 THEN 'AREA' ELSE 'ROUTE' END AS kind,
      -3.46e1 + ((key * 7919) % 2000 - 1000) / 1e4 AS latitude, -5.84e1 + ((key * 104729) % 2000 - 1000) / 1e4 AS longitude
      FROM (SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey + 1000003, c_name FROM customer))""",
    "experience": f"""experience_base AS (SELECT p_partkey AS experience_id, p_name AS name, p_retailprice AS price, CAST(p_size * 3 + 30 AS BIGINT) AS duration_minutes,
      CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 37 % 51) / 1e1 END AS rating, (p_partkey * 101) % 3000 AS reviews,
      CASE WHEN p_partkey % 4 = 0 THEN (p_partkey * 13) % 400 END AS notability, p_partkey % 3 = 0 AS editorial,
      CASE WHEN p_partkey % 7 = 0 THEN 'DRAFT' ELSE 'VERIFIED' END AS status, p_type AS kind, lower(p_brand) AS brand FROM part),
    experience_signal AS (SELECT *, CASE WHEN rating BETWEEN 0 AND 5 THEN 2.5e0 + (rating - 2.5e0) * {_LOG.format(n='reviews', cap='1e3')} END AS places_score,
      CASE WHEN notability IS NOT NULL THEN 2.5e0 + 2e0 * {_LOG.format(n='notability', cap='3e2')} END AS notability_score,
      CASE WHEN editorial THEN 3.5e0 END AS editorial_score FROM experience_base),
    experience AS (SELECT *, CASE WHEN places_score IS NOT NULL OR notability_score IS NOT NULL OR editorial_score IS NOT NULL THEN least(5e0, greatest(0e0,
      (coalesce(places_score, 0e0) + coalesce(editorial_score, 0e0) * 6e-1 + coalesce(notability_score, 0e0) * 6e-1)
      / (CASE WHEN places_score IS NULL THEN 0e0 ELSE 1e0 END + CASE WHEN editorial_score IS NULL THEN 0e0 ELSE 6e-1 END + CASE WHEN notability_score IS NULL THEN 0e0 ELSE 6e-1 END))) END AS quality FROM experience_signal)""",
    "component": """component AS (SELECT experience_id, entity_id, row_number() OVER (PARTITION BY experience_id ORDER BY entity_id) AS position,
      CASE WHEN (experience_id + entity_id) % 13 = 0 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS state
      FROM (SELECT DISTINCT l_partkey AS experience_id, l_suppkey AS entity_id FROM lineitem))""",
    "facet": """facet AS (SELECT DISTINCT p_partkey AS experience_id, 'theme' AS dimension, unnest(string_split(lower(p_name), ' ')) AS facet FROM part
      UNION SELECT p_partkey, 'trait', lower(p_brand) FROM part)""",
    "request": "request(request_id, latitude, longitude, radius_m, days, pace, theme) AS (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {r!r}::DOUBLE, {d}, '{p}', '{t}')" for i, a, b, r, d, p, t in REQUESTS) + ")",
    "outbox": """outbox AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type IN ('click', 'view') THEN 'PROCESSED' WHEN event_type = 'purchase' THEN 'PROCESSING' ELSE 'PENDING' END AS status,
      ts AS created_at, CAST(event_id % 6 AS INTEGER) AS attempts, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
}


def with_(names: str, body: str) -> str:
    """SQL of a query over derived tables."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
