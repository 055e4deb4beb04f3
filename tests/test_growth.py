"""Steps whose memory or shuffled bytes grew with the table: what their plans sort, deal and shuffle now."""

import contextlib
import io
import re

import pyarrow as pa

from wayloom.operators import templates
from wayloom.plans import catalog
from wayloom.sources import catalog as c


def plan(df):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        df.explain()
    return told.getvalue()


def dealt(text):
    """The keys of every shuffle."""
    return [[k.split("#")[0].strip() for k in keys.split(",")[:-1]] for keys in re.findall(r"Exchange hashpartitioning\((.*?)\), ", text)]


def test_tasks_follow_the_rows(spark, sf):
    n = c.read(spark, sf, "lineitem").count()
    assert c.tasks(spark, sf, "lineitem", 10) == -(-n // 10)
    assert c.tasks(spark, sf, "lineitem") == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_segments_sort_a_document_once(spark, sf):
    text = plan(catalog.QUERIES["op_txt_07_segments"](spark, sf))
    assert "leg#" not in " ".join(re.findall(r"Sort \[(.*)", text))
    assert text.count("REPARTITION_BY_NUM") == 3
    assert dealt(text).count(["doc"]) == 2 and ["doc", "atom"] not in dealt(text)


def test_metadata_is_shuffled_as_lines_only(spark, sf):
    text = plan(catalog.QUERIES["op_agg_16_metadata_merge"](spark, sf))
    assert all(keys in (["l_partkey"], ["p_partkey"]) for keys in dealt(text)), dealt(text)


def test_destinations_are_shuffled_as_bits(spark, sf):
    keys = dealt(plan(catalog.QUERIES["op_geo_12_destination_relation"](spark, sf)))
    assert ["experience_id"] in keys and not any("area_id" in k for k in keys)


def test_source_pairs_are_not_shuffled(spark, sf):
    keys = dealt(plan(catalog.QUERIES["op_er_07_source_relation"](spark, sf)))
    assert not any("left_id" in k or "right_id" in k for k in keys)
    assert any(k[-2:] == ["_i", "_j"] for k in keys)


def test_compositions_rank_parts_of_narrow_rows(spark, sf):
    text = plan(catalog.QUERIES["op_rank_06_composition"](spark, sf))
    assert ["request_id", "_of", "_part"] in dealt(text)


def test_listings_leave_a_task_a_set_number_at_a_time():
    texts = ["{{see|name=a}} {{eat|name=b}} {{x|y}}"] * 3000 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    out = list(templates.listed(iter([batch])))
    assert max(b.num_rows for b in out) == templates.AT_ONCE
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["ordinal"]) for r in rows] == [(d, k) for d in range(3000) for k in (1, 2, 3)]


def test_wishes_are_dealt_while_narrow(spark, sf):
    for name in ("op_plan_04_hard_constraints", "op_plan_06_local_improvement", "op_plan_07_routed_order", "op_plan_08_repair"):
        text = plan(catalog.QUERIES[name](spark, sf))
        assert [k for k in dealt(text) if "request_id" in k] == [["request_id"]], name
        assert "REPARTITION_BY_NUM" in text and not re.search(r"Exchange .*\n.*Project \[.*hours#", text), name
