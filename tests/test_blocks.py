"""Pairs of rows with equal keys: each once, dealt evenly, told once per pair of copies."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from wayloom.operators.blocks import dealt, row_pairs, told_pairs
from wayloom.operators.clusters import complete_links
from wayloom.plans import catalog


def test_told_pairs_are_all_pairs_with_the_direction_of_the_ids(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("uuuv"), draw.choice(["a", "bb", "ccc", None]), draw.choice([1, 2, 3, 5, 6, None])) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, k string, a string, size int")
    told = lambda x, y: F.concat_ws(">", x("a"), y("a"))
    text = lambda a, b: ">".join(v for v in (a, b) if v is not None)
    got = sorted(map(tuple, told_pairs(t, ["k"], ["a"], told).collect()))
    assert got == sorted((p[0], q[0], text(p[2], q[2])) for p, q in combinations(rows, 2) if p[1] == q[1])
    got = sorted(map(tuple, told_pairs(t, ["k"], ["a", "size"], told, near="size").collect()))
    assert got == sorted((p[0], q[0], text(p[2], q[2])) for p, q in combinations(rows, 2) if p[1] == q[1] and None not in (p[3], q[3]) and abs(p[3] - q[3]) <= 1)
    assert sorted(map(tuple, row_pairs(t.select("id", "k"), ["k"]).select("x_id", "y_id").collect())) == sorted((p[0], q[0]) for p, q in combinations(rows, 2) if p[1] == q[1])


def test_evidence_has_every_distance_of_sizes(spark, tmp_path):
    """All pairs of a brand and type, whatever their sizes: each bonus is given, none where a size is unknown."""
    import duckdb

    draw = random.Random(11)
    rows = [(i, draw.choice(["red ring", "red bolt", "blue ring", "bolt"]), "B", draw.choice("tu"), draw.choice([1, 2, 6, 7, 16, 17, 40, None])) for i in range(120)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.QUERIES["op_math_10_evidence_score"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.SQL["op_math_10_evidence_score"]).fetchall())
    assert {(r.left_id, r.right_id) for r in got} == {(p[0], q[0]) for p, q in combinations(rows, 2) if p[3] == q[3]}
    names = {i: r[1] for i, r in enumerate(rows)}
    assert {r.score for r in got if names[r.left_id] == names[r.right_id]} == {0.45, 0.41, 0.37}


def test_one_key_is_dealt_to_many_tasks(spark):
    left, right = dealt(spark.range(4000).withColumn("k", F.expr("id div 100000")), ["k"], "id", 100)
    met = left.withColumnRenamed("id", "l").hint("merge").join(right, ["k", "_i", "_j"]).where("l < id")
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 * 3999 // 2 and len(sizes) == 8 and max(sizes) < sum(sizes) / 4


def test_name_pairs_fill_the_tasks(spark, sf):
    for name in ("op_str_07_token_overlap", "op_str_09_name_correspondence", "op_math_10_evidence_score"):
        assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() == 8


def test_names_are_folded_before_proposals_meet(spark, sf):
    plan = catalog.QUERIES["op_er_10_pair_decision"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan[: plan.index("Join")]


def test_complete_links_across_blocks_and_batches(spark):
    draw = random.Random(5)
    pairs = [(b, b * 100 + i, b * 100 + j) for b in range(12) for i, j in combinations(range(30), 2) if draw.random() < 0.6]
    want = {}
    for b in range(12):
        same, clusters = {(i, j) for c, i, j in pairs if c == b}, []
        for i in sorted({v for p in same for v in p}):
            fits = [m for m in clusters if all((j, i) in same for j in m)]
            fits[0].append(i) if len(fits) == 1 else clusters.append([i])
        want |= {i: m[0] for m in clusters for i in m}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = complete_links(spark.createDataFrame(pairs, "b int, left_id long, right_id long"), ["b"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.id, r.cluster) for r in found) == sorted(want.items())


def test_copies_of_a_place_meet_once(spark, sf, monkeypatch):
    """Joins of near points get one row per place, however many copies it has, and give what all copies get."""
    from wayloom.operators import spatial, upsert
    from wayloom.plans import overlap
    from wayloom.sources.shared import Tables

    met = []

    def counted(left, right, *rest):
        met.append((left.count(), right.count()))
        return near_pairs(left, right, *rest)

    near_pairs = spatial.near_pairs
    for module in (spatial, upsert, overlap):
        monkeypatch.setattr(module, "near_pairs", counted)
    points = spark.range(900).select("id", (F.col("id") % 3 * 0.003).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit("p").alias("kind"))
    got = spatial.nearest_match(points, points.withColumn("id", F.col("id") + 5000), 150.0, "id", "id", ("kind",)).collect()
    assert sorted((r._a, r._b) for r in got) == [(i, 5000 + i % 3) for i in range(900)] and met == [(3, 3)]
    entities = points.where("id < 2").select(F.col("id").alias("entity_id"), F.lit("Plaza").alias("name"), "kind", "latitude", "longitude")
    ids = spark.createDataFrame([], "id string, entity_id long")
    batch = points.select(F.col("id").alias("seq"), F.array().cast("array<string>").alias("ids"), F.lit("plaza").alias("name"), "kind", "latitude", "longitude")
    out = {r.seq: (r.outcome, r.entity_id) for r in upsert.decided(entities, ids, batch, Tables(spark, "copies")).collect()}
    assert out == {i: ("ATTACHED", i % 3) if i % 3 < 2 else ("CREATED" if i == 2 else "JOINED", 2) for i in range(900)}
    assert max(max(m) for m in met) <= 3


def test_density_needs_no_ranks_of_members(spark, sf):
    plan = catalog.QUERIES["op_flt_04_poi_density"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [latitude" in plan


def test_displays_meet_asked_names_once(spark, sf):
    plan = catalog.QUERIES["op_str_11_gazetteer_match"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [display" in plan
