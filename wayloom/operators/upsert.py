"""A batch of observed places merged into a stored table of entities and their identities, and versions of such tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..sources.shared import Tables
from .elimination import eliminated
from .graph import components
from .order import total_rank
from .spatial import located, near_pairs

#: Places of one kind and name count as one within so many metres (fixed value).
SAME_PLACE_M = 150.0
DATA = ("name", "kind", "latitude", "longitude")


def _places(rows: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """Places of rows that have a position, a kind and a name, one per folded name, told by the least id: (id_, name, kind,
    latitude, longitude); and the rows with that of their place: (id_, place). Rows of a place are alike to the same others."""
    told = located(rows).select(id_, norm_name(F.col("name")).alias("name"), *DATA[1:]).where("name <> '' and kind is not null")
    places = told.groupBy(*DATA).agg(F.min(id_).alias("place"))
    return places.withColumnRenamed("place", id_), told.join(places, list(DATA)).select(id_, "place")


def _alike(left: DataFrame, right: DataFrame, id_left: str, id_right: str) -> DataFrame:
    """(_a, _b, distance_m) of places of one kind, near each other, whose names match."""
    near = near_pairs(left, right, SAME_PLACE_M, id_left, id_right, ("kind",))
    named = near.join(left.select(F.col(id_left).alias("_a"), F.col("name").alias("_na")), "_a").join(right.select(F.col(id_right).alias("_b"), F.col("name").alias("_nb")), "_b")
    return named.where(F.contains("_na", F.col("_nb")) | F.contains("_nb", F.col("_na"))).select("_a", "_b", "distance_m")


def _owned(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """(seq, owners, owner): how many entities own the ids of a row, and the one if it is one."""
    ids = rows.select("seq", F.explode("ids").alias("id")).distinct()
    return ids.join(identities.select("id", "entity_id"), "id").groupBy("seq").agg(F.count_distinct("entity_id").alias("owners"), F.min("entity_id").alias("owner"))


def decided(entities: DataFrame, identities: DataFrame, batch: DataFrame, tables: Tables) -> DataFrame:
    """(seq, outcome, entity_id) of every row of a batch.

    A row whose ids one entity owns is an UPDATE of it; ids of several make it a CONFLICT, which writes nothing. A row that
    nobody owns is ATTACHED to the nearest entity of its kind whose name matches, ties to the smaller id; rows of one id go
    where the first of them that is near something does, and a row whose ids go apart is a CONFLICT. What is left are new
    places: rows that share ids are one, told by the first; going through these by seq, each is CREATED unless it is the
    same place as an earlier created one, which it has JOINED then, as the other rows of its ids have. The stored tables are
    read as they were before the batch, so the outcome doesn't depend on how rows are dealt, and a batch that comes again
    writes what it wrote, to the same entities.
    """
    first = tables.save(batch.select("seq", "ids", *DATA).join(_owned(batch, identities), "seq", "left"))
    known = first.where("owners > 0").select("seq", F.when(F.col("owners") > 1, "CONFLICT").otherwise("UPDATE").alias("outcome"), F.when(F.col("owners") == 1, F.col("owner")).alias("entity_id"))
    open_ = first.where("owners is null").drop("owners", "owner")
    asked, at = map(tables.save, _places(open_, "seq"))
    best = _alike(asked, _places(entities, "entity_id")[0], "seq", "entity_id").groupBy("_a").agg(F.min(F.struct("distance_m", F.col("_b").alias("e"))).alias("x"))
    near = tables.save(at.join(best, F.col("place") == F.col("_a")).select("seq", F.col("x.e").alias("entity_id")))
    taken = tables.save(near.join(open_.select("seq", F.explode("ids").alias("id")), "seq").groupBy("id").agg(F.min_by("entity_id", "seq").alias("entity_id")))
    by_id = _owned(open_, taken).select("seq", F.when(F.col("owners") > 1, "CONFLICT").otherwise("ATTACHED").alias("outcome"), F.when(F.col("owners") == 1, F.col("owner")).alias("entity_id"))
    nameless = near.join(open_.where(F.size("ids") == 0).select("seq"), "seq", "left_semi").select("seq", F.lit("ATTACHED").alias("outcome"), "entity_id")
    attached = tables.save(by_id.unionByName(nameless))
    new = tables.save(open_.join(attached.select("seq"), "seq", "left_anti"))
    ids = new.select("seq", F.explode("ids").alias("id")).distinct()
    # Rows of one id form a star around the first of them, not all pairs.
    star = ids.withColumn("b", F.min("seq").over(Window.partitionBy("id"))).where("seq <> b").select(F.col("seq").alias("a"), "b")
    units = components(star, tables).select(F.col("node").alias("seq"), F.col("component").alias("lead"))
    led = tables.save(units.where("seq <> lead"))
    heads = tables.save(new.join(led.select("seq"), "seq", "left_anti"))
    # Of the rows of a place only the first can stay; the others fall to it, or with it to what it falls to.
    first, at = map(tables.save, _places(heads, "seq"))
    pairs = _alike(first, first, "seq", "seq").where("_a < _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    fallen = tables.save(eliminated(first.select(F.col("seq").alias("id")), pairs, [F.col("id").alias("at")], tables))
    lost = at.join(fallen.withColumnRenamed("id", "place"), "place", "left").select(F.col("seq").alias("id"), F.coalesce("by", "place").alias("by"))
    lost = tables.save(lost.where("id <> by"))
    created = heads.select("seq").join(lost.select(F.col("id").alias("seq")), "seq", "left_anti")
    top = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0))).first()[0]
    made = tables.save(total_rank(created, F.col("seq")).select("seq", F.lit("CREATED").alias("outcome"), (F.col("rank") + F.lit(top)).cast("long").alias("entity_id")))
    joined = lost.select(F.col("id").alias("seq"), F.col("by").alias("b")).join(made.select(F.col("seq").alias("b"), "entity_id"), "b").select("seq", F.lit("JOINED").alias("outcome"), "entity_id")
    whole = tables.save(made.unionByName(joined))
    members = led.join(whole.select(F.col("seq").alias("lead"), "entity_id"), "lead").select("seq", F.lit("JOINED").alias("outcome"), "entity_id")
    return tables.save(known.unionByName(attached).unionByName(whole).unionByName(members))


def upserted(entities: DataFrame, identities: DataFrame, batch: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, identities, outcomes) after a batch.

    entities (entity_id, name, kind, latitude, longitude), identities (id, entity_id), batch (seq, ids, the same data); seq
    tells rows apart and orders them. An entity takes the data of the last row that writes to it; an id that nobody owned
    goes to the entity of its first row. A null list of ids is empty, a row without a place is near nothing.
    """
    batch = batch.withColumn("ids", F.filter(F.coalesce("ids", F.array().cast("array<string>")), lambda i: i.isNotNull()))
    outcomes = decided(entities, identities, batch, tables)
    writes = outcomes.where("entity_id is not null").join(batch, "seq")
    data = writes.groupBy("entity_id").agg(F.max_by(F.struct(*DATA), "seq").alias("x")).select("entity_id", "x.*")
    kept = entities.select("entity_id", *DATA).join(data.select("entity_id"), "entity_id", "left_anti")
    claims = writes.select("seq", "entity_id", F.explode("ids").alias("id")).groupBy("id").agg(F.min_by("entity_id", "seq").alias("entity_id"))
    fresh = claims.join(identities.select("id"), "id", "left_anti")
    return kept.unionByName(data), identities.select("id", "entity_id").unionByName(fresh.select("id", "entity_id")), outcomes


class Versions:
    """Tables of a folder that change together: a version is a folder of them, and stands once its mark is there. Readers take
    the last that stands, so a writer that dies leaves nothing behind that is read. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last version that stands, 0 without any."""
        if not self.files.exists(self.path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.root))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".mark")), default=0)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.last()}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        version = self.last() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        self.files.create(self.path(f"{self.root}/v{version}.mark"), False).close()
        return version
